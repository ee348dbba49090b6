"""Shapes of personal details in one text: what is certain by itself, and candidates that need support.

mentions(text, ...) gives tuples (kind, start, stop, sure, given, family, turned, contexts). Offsets count
code points. A candidate carries the lexical contexts it stands in; whether they speak for it is
learned from the whole corpus in lexmill.llm.pii.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

Mention = tuple[str, int, int, bool, str | None, str | None, bool, list[str]]

_GAP = r"(?:[ \t ]{1,2}|[ ]{4}|[ \t]{0,2}\r?\n[ \t]{0,2})"
_I = re.IGNORECASE

# Cheap tests on lower-cased text, made before a pattern is tried.
_SPELLED_KEYS = ("dot", "[at]", "(at)", "{at}")
_LABEL_KEYS = ("ssn", "sec.", "secur", "insur", "segur", "sécu", "tax", "tin", "passport", "pasap", "passep", "steuer", "ausweis", "reisepass", "passn", "pass-n", "sozial", "renten", "dni", "nif", "nie", "nir", "nino", "ni n", "ni\nn", "ni  n", "identi", "licen", "fiscal", "id ")
_STREET_KEYS = ("street", "st", "lane", "ln", "ave", "road", "rd", "court", "ct", "drive", "close", "crescent", "terrace", "blvd", "boul", "gardens", "grove", "mews", "parade", "square", "place", "way", "box", "postfach", "apartado", "apdo", "postale", "bp", "b.p", "straße", "str.", "gasse", "weg", "platz", "allee", "ring", "damm", "am ", "im ", "der ", "den ", "zum ", "zur ", "dem ", "am\n", "calle", "c/", "avda", "av.", "plaza", "paseo", "pº", "camino", "carretera", "ronda", "traves", "rue", "impasse", "chemin", "allée", "quai", "route", "cours", "sentier", "passage")
_DIGITS = re.compile(r"\d+")
_BLANK = re.compile(r"\s")
#: Characters around a number in which its label or street may stand; numbers nearer than NEAR go together.
_AROUND, _NEAR = 72, 24

# --- email -------------------------------------------------------------------------------------
_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]*"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+\-]){_LOCAL}@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{{2,}}")
_AT = rf"(?:{_GAP}?(?:\[at\]|\(at\)|\{{at\}}|<at>){_GAP}?|{_GAP}at{_GAP})"
_DOT = rf"(?:{_GAP}?(?:\[dot\]|\(dot\)|\{{dot\}}|<dot>){_GAP}?|{_GAP}dot{_GAP})"
_SPELLED = re.compile(rf"(?<![A-Za-z0-9._%+\-]){_LOCAL}(?:{_AT}[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)+|{_GAP}?(?:\[at\]|\(at\)|\{{at\}}){_GAP}?[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{{2,}}|@[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)+)", _I)

# --- phone -------------------------------------------------------------------------------------
_S = rf"(?:[.\-/ ]|{_GAP})"
_PHONE = re.compile(
    r"(?<![\w+#@=./\-])(?<!\d[ ,])(?:"
    rf"(?:\+1{_S}|1-|\+1)?(?:\([2-9]\d\d\)[ ]?{_GAP}?|[2-9]\d\d{_S})[2-9]\d\d{_S}\d{{4}}"  # North America
    rf"|(?:\+44{_GAP}?\(?0?\)?|\(\+44\){_GAP}?|0044{_S}|0)20{_S}\d{{4}}{_S}\d{{4}}"  # London
    rf"|(?:(?:\+49{_S}|0049{_S}|\(\+49\){_GAP}?)\d{{2,4}}|\(0\d{{2,4}}\)|0\d{{2,4}}[/]){_S}?\d{{3,8}}(?:{_S}\d{{2,5}})?"  # Germany
    rf"|(?:(?:\+34|0034|\(\+34\)){_S}?)[6789]\d\d(?:{_S}?\d{{3}}{_S}?\d{{3}}|(?:{_S}?\d\d){{3}})|[6789]\d\d(?P<es>[ .\-]{{1,2}}|\s)\d{{3}}(?P=es)\d{{3}}"  # Spain
    rf"|(?:(?:\+33|0033|\(\+33\)){_S}?\(?0?\)?[1-9]|0[1-9])(?:{_S}\d\d){{4}}"  # France
    r"|(?P<plain>[2-9]\d\d[2-9]\d{6}|0[1-9]\d{8})"
    r")(?![\d/=])(?!\.\d)(?!-\d)(?![ ,]\d{1,4}[ ,]\d)"
)

#: Any grouped number that a plus sign, a parenthesis or a zero opens; how people write numbers around it decides.
_ANY_PHONE = re.compile(rf"(?<![\w+#@=./\-])(?<!\d[ ,])(?=[+(0])\+?\(?\d{{1,5}}\)?(?:{_S}{{1,2}}\(?\d{{1,6}}\)?){{1,6}}(?![\d/=])(?!\.\d)(?!-\d)")

# --- identity numbers --------------------------------------------------------------------------
_LABEL = (
    r"(?:SSN|soc\.[\s]+sec\.(?:[\s]+(?:number|no\.?))?|social[\s]+security(?:[\s]+(?:number|no\.?|nr\.?))?|social[\s]+insurance[\s]+(?:number|no\.?)|national[\s]+insurance(?:[\s]+(?:number|no\.?))?|NI[\s]+(?:number|no\.?)|NINO"
    r"|tax(?:payer)?[\s]+(?:identification[\s]+)?(?:ID|number|no\.?)|TIN|ITIN|passport(?:[\s]+(?:number|no\.?))?|(?:national[\s]+)?(?:identity|ID)[\s]+(?:card|document)(?:[\s]+(?:number|no\.?))?|driving[\s]+licen[cs]e(?:[\s]+(?:number|no\.?))?"
    r"|Steuer(?:-?ID(?:entifikationsnummer)?|nummer|-?Identifikationsnummer|-?Nr\.?)|Ausweis(?:nummer|-?Nr\.?)|Personalausweis(?:nummer|-?Nr\.?)?|Reisepass(?:nummer|-?Nr\.?)?|Pass(?:nummer|-?Nr\.?)|Sozialversicherungs(?:nummer|-?Nr\.?)|Rentenversicherungsnummer"
    r"|DNI|NIF|NIE|documento[\s]+(?:nacional[\s]+)?de[\s]+identidad|(?:número[\s]+de[\s]+)?pasaporte|número[\s]+de[\s]+(?:la[\s]+)?seguridad[\s]+social|número[\s]+de[\s]+identificación(?:[\s]+fiscal)?|carné[\s]+de[\s]+identidad"
    r"|NIR|(?:numéro|n[°º])[\s]+de[\s]+sécu(?:rité[\s]+sociale)?|numéro[\s]+fiscal|numéro[\s]+de[\s]+passeport|passeport|numéro[\s]+de[\s]+carte[\s]+d[’']identité|carte[\s]+d[’']identité(?:[\s]+numéro)?)"
)
_VALUE = r"(?=(?:[A-Za-z0-9][ \-.\r\n]{0,2}){6,})(?:[12](?:[ ]{1,2}\d\d){3}[ ]{1,2}\d{3}[ ]{1,2}\d{3}(?:[ ]{1,2}\d\d)?|[A-Za-z]{0,2}[ ]{0,2}\d(?:[ \-.\r\n]{0,2}\d){4,14}(?:[ \-]{0,2}[A-Za-z](?![A-Za-z]))?|[A-Za-z0-9]*\d[A-Za-z0-9]*\d[A-Za-z0-9]*\d[A-Za-z0-9]*)"
_LABELLED = re.compile(rf"(?<![\w]){_LABEL}[\s]*(?:[:#=\-–]|n[º°o]\.?|Nr\.?|no\.?)?[\s]*[#:]?[\s]*(?P<v>{_VALUE})(?![\w])", _I)
_BARE_ID = re.compile(r"(?<![\w\-/.])(?:\d{3}-\d\d-\d{4}|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z](?: ?\d\d){3} ?[A-D]|[XYZ]\d{7}-?[A-Z]|\d{8}-?[A-HJ-NP-TV-Z])(?![\w\-/])")
_SOME_ID = re.compile(r"(?<![\w\-/.,:=<])(?=[A-Z0-9\-]{8,16}(?![\w]))(?:[A-Z]{1,2}\d{6,9}[A-Z]?|\d{2}-\d{7}|\d{9}|\d{11}|\d{15}|[A-Z]\d{7}[A-Z])(?![\w\-/.]\d|\w)|(?<![\w\-/.,:=<\d])(?<!\d[ ,])(?:\d{3}[ ]{1,2}\d\d[ ]{1,2}\d{4}|\d\d(?:[ ]{1,2}\d{3}){3}|[12](?:[ ]{1,2}\d\d){3}(?:[ ]{1,2}\d{3}){2}[ ]{1,2}\d\d)(?![\w\-/]|[ ,]\d)")

# --- addresses ---------------------------------------------------------------------------------
_CAP = r"[A-ZÀ-ÖØ-Þ][\w’'\-]*"
_STREET = r"(?:Street|St|Lane|Ln|Avenue|Ave|Road|Rd|Court|Ct|Drive|Close|Crescent|Terrace|Boulevard|Blvd|Gardens|Grove|Mews|Parade|Square|Place|Way)"
_ADDRESSES = [
    re.compile(rf"(?<![\w.,#\-/])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite){_GAP}\d+[A-Za-z]?,?{_GAP})?\d{{1,5}}[A-Za-z]?{_GAP}(?:{_CAP}{_GAP}){{1,3}}(?:{_STREET}|{_STREET.upper()})(?![\w])"),
    re.compile(rf"(?<![\w.,#\-/])(?:(?:flat|apt\.?|apartment|unit|suite){_GAP}\d+[a-z]?,?{_GAP})?\d{{1,5}}[a-z]?{_GAP}(?:[a-zß-öø-ÿ][\w’'\-]*{_GAP}){{1,3}}(?:street|lane|ave|avenue|road|rd|court|boulevard)(?=[.,;\n]|{_GAP}(?:in|/|-)|$)(?![\w])"),
    re.compile(rf"(?<![\w])(?:P\.?[ ]{{0,2}}O\.?{_GAP}?Box|Post{_GAP}?Office{_GAP}Box|Postfach|Apartado(?:{_GAP}(?:de{_GAP})?Correos)?|Apdo\.?|Boîte{_GAP}Postale|BP|B\.P\.){_GAP}(?:n[º°o]\.?{_GAP}?)?\d{{1,6}}(?!\w)", _I),
    re.compile(rf"(?<![\w\-])(?:{_CAP}{_GAP}(?:Straße|Strasse|STRASSE|STRAßE|Str\.|Weg|Platz|Allee|Gasse|Ring|Damm)|[A-ZÄÖÜ][\w\-]*(?:straße|strasse|STRASSE|str\.|gasse|GASSE|weg|platz|allee|damm)){_GAP}\d{{1,4}}[ ]?[a-zA-Z]?(?!\w)(?!\.\d)"),
    re.compile(rf"(?<![\w\-])(?:[a-zäöüß][\w\-]*er{_GAP}straße|[a-zäöüß][\w\-]+(?:straße|strasse|gasse)){_GAP}\d{{1,4}}[a-z]?(?!\w)(?!\.\d)"),
    re.compile(rf"(?<![\w\-])(?:Am|Im|An{_GAP}der|An{_GAP}den|Zum|Zur|Auf{_GAP}dem|Auf{_GAP}der|In{_GAP}der|Hinter{_GAP}der|Unter{_GAP}den){_GAP}(?:{_CAP}{_GAP}){{1,2}}\d{{1,4}}[a-z]?,{_GAP}(?:D-)?\d{{5}}(?!\d)", _I),
    re.compile(rf"(?<![\w])(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Paseo|Pº|Camino|Carretera|Ronda|Travesía){_GAP}?(?:(?:de(?:l|{_GAP}la|{_GAP}los|{_GAP}las)?|la|el|los|las){_GAP})*(?:{_CAP},?{_GAP}){{1,4}}(?:n[º°o]\.?{_GAP}?)?\d{{1,4}}(?!\d)"),
    re.compile(rf"(?<![\w])(?:calle|c/|avenida|paseo){_GAP}?(?:(?:de(?:l|{_GAP}la|{_GAP}los|{_GAP}las)?){_GAP})?(?:[a-záéíóúñ]+,?{_GAP}){{1,3}}(?:n[º°o]\.?{_GAP}?)?\d{{1,4}}(?!\d)", _I),
    re.compile(rf"(?<![\w.,#\-/])\d{{1,4}}(?:{_GAP}?(?:bis|ter|quater))?,?{_GAP}(?:rue|avenue|impasse|chemin|allée|quai|boulevard|route|cours|square|ruelle|sentier|place|passage){_GAP}(?:de|du|des|d[’']|la|le|les|l[’']|{_CAP})[\w’'\-]*", _I),
]

#: Capitalised words after or before a house number, whatever the kind of street; contexts decide.
_ANY_ADDRESS = re.compile(rf"(?<![\w.,#\-/+])(?:\d{{1,4}}[A-Za-z]?(?:{_GAP}{_CAP}){{2,3}}(?=[,.;\n]|{_GAP}|$)|(?:{_CAP}{_GAP}){{2,4}}\d{{1,4}}(?=,{_GAP}\d{{4,5}}(?!\d)))")

# --- names -------------------------------------------------------------------------------------
_UP = "A-ZÀ-ÖØ-Þ"
_PART = rf"[{_UP}](?:[\w¡-¿\xad]|[’'](?=\w))*"
_WORD = rf"{_PART}(?:-{_PART})*"
_INITIAL = rf"[{_UP}]\.(?:[ ]{{0,2}}[{_UP}]\.)?"
_FORWARD = re.compile(rf"(?<![\w@.+/’'\-¡-¿])(?=(?P<g>{_WORD}|{_INITIAL})(?:{_GAP}(?P<m>{_INITIAL}))?{_GAP}(?P<f>{_WORD})(?![\w@+¡-¿]|[._\-]\w))")
_TURNED = re.compile(rf"(?<![\w@.+/’'\-¡-¿])(?=(?P<f>{_WORD}),{_GAP}(?P<g>{_WORD}|{_INITIAL})(?![\w@+¡-¿]|[_\-]\w|\.[\w]))")
_LOWER = re.compile(r"(?<![\w@.+/’'\-])(?=(?P<g>[^\W\d_A-ZÀ-ÖØ-Þ][\w’'\-]+)(?P<c>,?)(?:[ ]{1,2}(?P<m>[a-z]\.))?[ \r\n]{1,2}(?P<f>[^\W\d_A-ZÀ-ÖØ-Þ][\w’'\-]+)(?![\w@+]|[._\-]\w))")
_LOWER_INITIAL = re.compile(r"(?<![\w@.+/’'\-])(?=(?P<g>[^\W\d_A-ZÀ-ÖØ-Þ]\.)[ ]{1,2}(?P<f>[^\W\d_A-ZÀ-ÖØ-Þ][\w’'\-]+)(?![\w@+]|[._\-]\w))")
_LOWER_START = re.compile(r"[.!?…;:/)-] {1,2}[a-zß-öø-ÿ]")
_SENTENCES = re.compile(r"(?<=[.!?…] )(?<![^\W\d_][.] )(?=[^\W\d_])|(?<=[^\W\d_]{2}[.] )")
_TITLE = re.compile(r"(?:Mister|Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sr|Sra|Señor|Señora|Don|Doña)\.?", _I)
_TOKEN = re.compile(r"[^\W\d_][\w’'\-]*\.?|\d+|[^\w\s]")
_TWO_CAPITALS = re.compile(rf"[{_UP}][\w’'\-.¡-¿\xad]*,?[ \t\r\n ]{{1,6}}[{_UP}]")


def fold(word: str) -> str:
    """A name part as looked up: lower case, straight apostrophe, text decoded twice put right."""
    if "Ã" in word or "Â" in word:
        try:
            word = word.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    return word.lower().replace("’", "'")


def _left(text: str, start: int) -> list[str]:
    tokens = [t.lower() for t in _TOKEN.findall(text[max(0, start - 60) : start])][-4:]
    return ["^"] * (4 - len(tokens)) + tokens


def _contexts(text: str, start: int, stop: int, emails: set[int]) -> list[str]:
    """The lexical contexts of a place: words before it, words on both sides, a title, a cell before an address."""
    left = _left(text, start)
    out = []
    if _TITLE.fullmatch(left[3]):
        left = ["^", *left[:3]]
        out.append("after a title")
    after = text[stop : stop + 40]
    right = [t.lower() for t in _TOKEN.findall(after)][:2] + ["$", "$"]
    if left[3][0].isalpha() or left[2][0].isalpha():
        out.append(f"{left[2]} {left[3]} _")
        out.append(f"{left[3]} _ {right[0]} {right[1]}")
    near = after.lstrip(" \t,;|:")
    at = stop + len(after) - len(near)
    if text[max(0, start - 12) : start].rstrip(" \t|")[-1:] in ("", "\n", "\r") and (at in emails or near.startswith("mailto:")):
        out.append("line _ email")
    return out


def _numbers(text: str) -> list[tuple[int, int, int]]:
    """Stretches around numbers: start, stop, most digits of numbers that stand near one another.

    A stretch ends at whitespace, and stretches that meet are one, so that none ends inside a
    number or word and a pattern searched up to the end sees whole shapes.
    """
    out: list[list[int]] = []
    near = last = 0
    for m in _DIGITS.finditer(text):
        a, b = m.span()
        near = near + b - a if out and a - last < _NEAR else b - a
        last = b
        joined = bool(out) and a - _AROUND <= out[-1][1]
        if not joined:
            out.append([max(0, a - _AROUND), 0, 0])
        if b + _AROUND > out[-1][1]:
            end = _BLANK.search(text, b + _AROUND)
            out[-1][1] = end.start() if end else len(text)
        out[-1][2] = max(out[-1][2], near)
    return [(a, b, n) for a, b, n in out]


def mentions(text: str, given: frozenset[str], family: frozenset[str], common: frozenset[str]) -> list[Mention]:
    """All mentions and candidates of a text, in order of kind and place."""
    out: list[Mention] = []
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        at = bisect_left(taken, (b, 0))  # taken never overlap, so only the last that starts before b can reach beyond a
        return not at or taken[at - 1][1] <= a

    def add(kind: str, a: int, b: int, sure: bool, contexts: list[str] | None = None) -> None:
        if free(a, b):
            out.append((kind, a, b, sure, None, None, False, contexts or []))
            insort(taken, (a, b))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add("email", m.start(), m.end(), True)
    low = text.lower()
    if any(k in low for k in _SPELLED_KEYS):
        for m in _SPELLED.finditer(text):
            add("email", m.start(), m.end(), True)
    emails = {a for a, _ in taken}
    for a, b, n_digits in _numbers(text):
        near = text[a:b].lower()
        if n_digits >= 3 and any(k in near for k in _LABEL_KEYS):
            for m in _LABELLED.finditer(text, a, b):
                if "\n" in m["v"] and sum(c.isdigit() for c in m["v"]) < 8:
                    continue  # a short number at a line's end and the number of the next line
                add("id_number", m.start("v"), m.end("v"), True, _contexts(text, m.start("v"), m.end("v"), emails))
        if n_digits >= 9:
            for m in _PHONE.finditer(text, a, b):
                bare = m.group("plain") is None or not _left(text, m.start())[3][0].isalpha()
                add("phone", m.start(), m.end(), bare, _contexts(text, m.start(), m.end(), emails))
        if n_digits >= 6:
            for m in _BARE_ID.finditer(text, a, b):
                add("id_number", m.start(), m.end(), True, _contexts(text, m.start(), m.end(), emails))
        if any(k in near for k in _STREET_KEYS):
            for shape in _ADDRESSES:
                for m in shape.finditer(text, a, b):
                    add("address", m.start(), m.end(), True, _contexts(text, m.start(), m.end(), emails))
        if n_digits >= 6:
            for m in _SOME_ID.finditer(text, a, b):
                add("id_number", m.start(), m.end(), False, _contexts(text, m.start(), m.end(), emails))

    for a, b, n_digits in _numbers(text):  # after all shapes, so that no generic candidate takes their place
        if n_digits >= 8:
            for m in _ANY_PHONE.finditer(text, a, b):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    add("phone", m.start(), m.end(), False, _contexts(text, m.start(), m.end(), emails))
        for m in _ANY_ADDRESS.finditer(text, a, b):
            add("address", m.start(), m.end(), False, _contexts(text, m.start(), m.end(), emails))

    def name(g: str, f: str, a: int, b: int, turned: bool) -> None:
        low_g, low_f = fold(g), fold(f)
        if (low_g in common and low_g not in given) or (low_f in common and low_f not in family) or _TITLE.fullmatch(g):
            return
        if free(a, b):
            first = "." if g.endswith(".") else low_g.split("-")[0]
            whole = text[a:b]  # in capitals or garbled, only known words make it a name
            plain = not (f.isupper() and len(f) > 1) and "Ã" not in whole
            out.append(("name", a, b, False, first, low_f, turned, _contexts(text, a, b, emails) if plain else []))

    at = 0
    while pair := _TWO_CAPITALS.search(text, at):
        a, at = pair.start(), pair.end() - 1
        if m := _FORWARD.match(text, a):
            name(m["g"], m["f"], a, m.end("f"), False)
        if m := _TURNED.match(text, a):
            name(m["g"], m["f"], a, m.end("g"), True)
    start = 0
    for line in text.split("\n"):
        at = start
        start += len(line) + 1
        if line.islower():
            parts = [line]
        elif _LOWER_START.search(line):
            parts = _SENTENCES.split(line)
        else:
            continue
        for part in parts:
            if len(part) > 8 and part.islower():
                stop = min(len(text), at + len(part) + 40)
                for m in _LOWER.finditer(text, at, stop):
                    g, f = (m["f"], m["g"]) if m["c"] else (m["g"], m["f"])
                    if m.start() < at + len(part) and (fold(g).split("-")[0] in given or fold(f) in family):
                        name(g, f, m.start(), m.end("f"), bool(m["c"]))
                for m in _LOWER_INITIAL.finditer(text, at, stop):
                    if m.start() < at + len(part) and fold(m["f"]) in family:
                        name(m["g"], m["f"], m.start(), m.end("f"), False)
            at += len(part)
    return out
