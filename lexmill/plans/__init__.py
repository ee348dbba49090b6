"""Named queries of the core with the SQL that must give the same rows."""

from lexmill.plans import additions, curation, evaluation, mining, pipeline, repair, texts, tokens, vocabularies  # noqa: F401
