"""Documents of the sf0.1 table read by eye, half of them near a bound of the definition on either side.

A row: 1 structure or junk, 0 prose; doc_id; the statistics of the whole text in the order of
quality.FEATURES; how the text begins (line ends shown as a bar). Labelled by reading alone: hard-wrapped
prose and prose with one overlong word are 0 though the loose bounds take them for structure, and
German text whose letters were decoded wrongly is 1 though the exact bounds mostly let it pass.
"""

HOLDOUT: list[tuple] = [
    (1, 256, (0.5254, 0, 0, 0, 5.6, 5, 1, 86, 0.314), '✨ ★ → salted %% ✨ ★ 🔥 @@ @@ 🔥 @@ → ★ → ✔ 🔥 🔥 curious → soup hostel dense'),
    (1, 26993, (0.1737, 59, 0, 0.01266, 3.734, 79, 17, 21, 0.0429), 'nr,piece,freq,class | 1,lem,89775,drop | 2,tuk,242609,keep_phrase | 3,ve'),
    (1, 1505, (0.2468, 48.4, 0, 0, 3.306, 36, 5, 31.6, 0.02469), 'nr;piece;freq;class | v078;0.521563;1.2786;904717;-0.704% | v034;0.59327'),
    (1, 26407, (0.2921, 0, 0, 0, 4.773, 66, 1, 575, 0.2261), 'Bright :: Login :: Home :: Chimney :: RSS :: Home :: Login :: Home :: Lo'),
    (1, 9720, (0.1972, 57.58, 0, 0.1188, 3.386, 101, 19, 22.42, 0.04054), 'radiator|frozen|48.85|yes | cable|partial|38.61|no | tractor|rural|25.22'),
    (1, 25130, (0.1981, 0, 1, 0.1184, 2.849, 152, 1, 602, 0.103), 'DeÃ« BaÃ®nhof iÃ¤Ã¢Ã£erbstÃ©ordnete dÃ¤Ã£Ã©KesselÃ\xadaÃ¨s GÃ®as. Ã\xadÃ«s FÃª'),
    (0, 8133, (0.1731, 0, 0.8, 0.3667, 5.256, 90, 5, 131.6, 0.1411), 'Its library merged the printer. In the end, some sunny editor folded her'),
    (1, 13757, (0.1778, 0, 1, 0.156, 3.055, 109, 1, 452, 0.104), 'DiÃ© Fähre verließ Ã¢asÃ\xadGÃ§triebe Ã©it die Fähre im HÃ¢rÃ¥st Ã¥Ã¤neÃ¥Ei'),
    (1, 26692, (0.1997, 0, 1, 0.1525, 2.767, 223, 1, 969, 0.2043), 'DÃ¢r  MÃ¨rkt  bÃªschÃ¥ieb  die  KücheÃ¤voÃ\xad  neÃ¡eÃ¤an  üÃ¥Ã«rÃ¡der  Ã¡a'),
    (1, 13854, (0.2018, 0, 0, 0, 6.214, 14, 1, 141, 0.227), 'tram 🔥 🔥 🔥 @@ → recipe @@ → ✨ ✨ 🔥 ✨ folded parade 🔥 ★ ✨ ★ ✔ bridge ✔ lem'),
    (1, 4909, (0.04695, 54, 0.05263, 0.3043, 5.884, 69, 19, 26, 0.168), 'However, the folded router postponed every match. | • repaired the weekl'),
    (1, 13370, (0.107, 57.82, 0, 0.2763, 3.842, 76, 17, 22.18, 0.1679), '1. el jardín | 2. la tabla | 3. la cocina, la bicicleta | 4. el modelo, '),
    (1, 22123, (0.1074, 63.67, 0, 0.5, 4.154, 26, 9, 16.33, 0.2194), '* la gare | * le fleuve, le voisin | * le modèle, la rue | * la biblioth'),
    (1, 19061, (0.1159, 67.86, 0, 0.5, 3.812, 16, 7, 12.14, 0.2418), '- la frase | - el barco | - la ventana | - la cocina | - la ventana | - '),
    (1, 15237, (0.09569, 68.55, 0, 0, 4.725, 40, 20, 11.45, 0.1573), 'Forklift: 484 | Kitchen: 243 | Moth: 28 | River: 424 | Gearbox: 235 | Tr'),
    (1, 23019, (0.05049, 56.77, 0, 0.2921, 5.494, 89, 26, 23.23, 0.1812), '* planted some bakery | * ranked his profiler | * collected the weekly c'),
    (0, 17394, (0.02353, 28.13, 0.1842, 0.4272, 5.372, 309, 38, 51.87, 0.1555), 'Still, our patient striker balanced one modest dough beside | this token'),
    (0, 2933, (0.03614, 30, 0.25, 0.4286, 4.571, 35, 4, 50, 0.1863), 'El jardín midió la bicicleta de ayer sin prisa, porque el taller sin nom'),
    (0, 11626, (0.0437, 27.76, 0.2941, 0.3741, 5.353, 139, 17, 52.24, 0.1422), 'Our painted blanket barely harvested her radiator on its router | althou'),
    (0, 12526, (0.03361, 27.29, 0.2083, 0.3929, 5.429, 196, 24, 52.71, 0.1452), 'His windy curtain outgrew our bright river behind her rusty | suitcase, '),
    (0, 13010, (0.02187, 30.75, 0.3333, 0.46, 4.92, 100, 12, 49.25, 0.1645), 'Das Gebäude von gestern ordnete der Hafen aus Blech. Die | Treppe im Kel'),
    (1, 10883, (0, 0, 0, 0, 6.765, 98, 1, 760, 0.1276), 'thrfmx bgzngwldth zhlgvvmxr whgwfgdkjv mmlzggrjb nfxxnvldq gmglklqw rtl '),
    (1, 16326, (0, 0, 0, 0, 6.393, 112, 1, 938, 0.2367), 'nkzts  stjnvkbhbz  nwr  vdcwdtbtcj  mdkvrhxds  zcqqglxjl  vqxlvvvwh  vnr'),
    (1, 17508, (0.1527, 0, 0, 0.03846, 5.301, 156, 13, 86.38, 0.1491), '| A. Abelmarsh | celestine.nethercotte@brieftaube.invalid | 1-305-555-01'),
    (1, 18767, (0, 0, 0, 0, 2.962, 156, 1, 617, 0.2512), '407 609 515 753 347 579 390 824 438 638 720 471 584 862 88 840 832 550 1'),
    (1, 10853, (0.08158, 0, 0, 0, 12.03, 29, 1, 380, 0), 'd9gc8H1Cj9g1BCFD01Cj47j2cgff31fCfBakC/C+DjHDHehDH7iehB3ibc/36afdfi0/7701'),
    (1, 2198, (0.07376, 5, 0, 0.01901, 5.825, 263, 24, 75, 0.0927), 'nr\tpiece\tfreq\tclass | Ilse Grünewaldt\tb.casterline@lettres.montclair.exa'),
    (1, 4038, (0.164, 0, 0, 0.1548, 3.155, 168, 1, 720, 0.1194), 'Das UferÃ®aus PapierÃ¢sammeÃªte dasÃ©Ergebnis miÃª Griff trotzÃ«die Ã¢tr'),
    (1, 7359, (0.1347, 0, 1, 0.1971, 3.328, 137, 1, 606, 0.1304), 'Der KeÃ®seÃª reinigte der BahnhofÃ\xadaÃ\xadseÃ¨tÃ¢Ã§die Ã¥rüÃ¡ke im HÃ¦rÃ\xadst.'),
    (1, 28171, (0.1498, 0, 0, 0.181, 3.235, 221, 1, 958, 0.1221), 'DaÃ¢Ã¡Ã£ahrrad erseÃ®Ã§te dÃªe Ã§traÃ¦e hinÃ«er dÃ¬r Ã®aÃªen ohne Namen,'),
    (1, 17078, (0.1514, 0, 1, 0.1685, 3.118, 178, 1, 751, 0.1292), 'Das Ufer iÃ¦ HeÃ«bÃ¦t liÃªfertÃ¬ Ã©er KÃ©rpus trotz Ã¨ie StichÃªrobÃ¦Ã¬ '),
    (1, 24301, (0.1552, 0, 1, 0.1801, 3.327, 211, 1, 948, 0.1234), 'Die BüchereÃ§ füÃ¨ Ã®lle öffnete Ã£iÃ® Ã©ÃªicÃ£probeÃ¦Ã©er Stadt vor das'),
    (1, 15168, (0.06579, 0, 0, 0, 17.75, 8, 1, 152, 0), 'H6g4jFde9BDb3jh25c6Big7jh86DHj2j5kkDAGHe9b3E852hd2k+aDjbifAE59Ha0/fic15g'),
    (1, 11140, (0.06557, 0, 0, 0, 16.29, 7, 1, 122, 0), 'Bce27a3eBEhfD3ChfC2/2ecjegc641/bgF7ab70DCikA03AC4B0He1ch+i281eHe0ghCgE5b'),
    (1, 28600, (0.07647, 0, 0, 0, 13.08, 12, 1, 170, 0), 'h+2+f6cHe/6AjAd3AGgB/3c+AfHe8621dk/g8eAafAghAB6222C9H5c98GCFj7/0HHiE8Hf3'),
    (1, 8089, (0.09701, 0, 0, 0, 10.08, 12, 1, 134, 0), 'B9gafh5FE64181/5i45iCHDDd+H4EC6Cb7gi+9h/hkcke79c8hBG6EDF8aa+b4+kHj70BAa9'),
    (1, 27801, (0.06494, 0, 0, 0, 16.94, 17, 1, 308, 0), 'EBC49c3fkk71fE7+Aih740ga00h8c3eHdhh7c62b3Fi7/+ifAg+c9CBH389kCjEcAjh4F55A'),
    (1, 13151, (0.06081, 0, 0, 0, 17.38, 16, 1, 296, 0), 'B0+6k4c0Eci8eAF22EA0ib8F444/bhAe9hF+389je76+/f06dD5GFD4dk1Fk6080hdE5i1DH'),
    (0, 15238, (0.01416, 0, 0.8333, 0.4242, 8.788, 198, 6, 326.2, 0.1004), 'By then, another marble harvested a curious tyre with one moth twice. Th'),
    (0, 4689, (0.01229, 0, 0.8333, 0.4085, 8.894, 235, 6, 390.8, 0.09957), 'Her partial soup neatly recorded the river over the patient normaliser. '),
    (0, 27530, (0.01558, 0, 0, 0.3953, 8.814, 43, 1, 427, 0.09836), 'The scooter merged a piece from our breakfast. Still, the dough sorted t'),
    (0, 24112, (0.01399, 0, 0.8, 0.42, 8.927, 150, 5, 300.6, 0.09887), 'The sample counted another phrase under the profiler. One spare budget p'),
    (0, 8709, (0.01459, 0, 0.875, 0.4198, 8.487, 374, 8, 448.4, 0.1038), 'The dense summit pushed the narrow trigram, while every suitcase pruned '),
    (0, 29914, (0.0254, 0, 1, 0.4304, 5.342, 79, 1, 511, 0.1526), 'As we said, that museum boiled another permanent mayor (fragile as it wa'),
    (0, 770, (0.02897, 0, 0.3333, 0.4138, 5.201, 174, 3, 368.3, 0.1581), 'One swap followed the ratio over the weekly suffix because the split tri'),
    (0, 28679, (0.0231, 0, 1, 0.3869, 5.286, 168, 4, 268.2, 0.1552), 'This time, the mayor followed that parish. My leaky ferry polished my pi'),
    (0, 27731, (0.0173, 0, 1, 0.4, 5.41, 105, 1, 682, 0.1525), 'This crooked reserve repaired my leaky lattice before the batch evenly t'),
    (0, 12041, (0.02317, 0, 1, 0.4239, 5.5, 92, 2, 304, 0.1508), 'On the whole, the annual library finished some match on my reliable grid'),
    (0, 12267, (0.028, 0, 1, 0.4118, 5.36, 136, 3, 294.3, 0.1545), 'Our beetle finished some temporary shelf without his reliable archive. M'),
    (0, 13913, (0.0209, 0, 1, 0.4601, 4.62, 213, 5, 242.6, 0.1769), 'La montaña urbano sustituyó el mercado para el resultado de papel, pero '),
    (0, 11063, (0.02304, 0, 1, 0.3967, 5.23, 300, 5, 380, 0.1583), 'The printer dragged the windy parcel in my tram. In the end, that rural '),
    (0, 12350, (0.03933, 0, 1, 0.4118, 4.421, 221, 4, 305.8, 0.1725), 'La montaña de madera sustituyó la tabla otra vez, pero la montaña revisó'),
    (0, 21148, (0.02371, 0, 1, 0.4342, 4.605, 152, 2, 433.5, 0.1749), 'El faro de papel ordenó el taller. La biblioteca alcanzó la maestra hast'),
    (0, 13831, (0.024, 0, 1, 0.4018, 5.446, 112, 3, 244.7, 0.1531), 'That village balanced its engine beside that dense library, because its '),
    (0, 19422, (0.02326, 0, 1, 0.427, 5.191, 89, 2, 280, 0.1584), 'On the whole, her publisher outgrew their poster 86 times. This fragile '),
    (0, 1319, (0.02193, 0, 1, 0.4299, 5.21, 214, 4, 337.5, 0.1593), 'Her skewed curtain sorted her charger without the sparse segmenter, befo'),
    (0, 10344, (0.03101, 0, 0.75, 0.3741, 5.396, 139, 4, 226.8, 0.1522), '<p>The permanent farmer covered a neighbour against a stubborn chimney, '),
    (0, 1175, (0.02208, 23.46, 0.1538, 0.4211, 5.439, 114, 13, 56.54, 0.1524), 'The sparse parish suddenly painted our window. The curious | candidate t'),
    (0, 133, (0.0292, 16, 0.2, 0.4314, 5.216, 51, 5, 64, 0.1543), 'One gearbox twice chopped the municipal maple before the drum. “Its post'),
    (0, 10262, (0.02016, 22.47, 0.06667, 0.4104, 5.44, 134, 15, 57.53, 0.1517), 'Her greedy flute started one noisy curtain beside the | courier. This st'),
    (0, 24156, (0.02614, 13, 0.25, 0.3882, 5.259, 85, 8, 67, 0.1547), 'This cottage sampled one lighthouse, when another square collected the |'),
    (0, 16874, (0.02259, 14.63, 0.2333, 0.4272, 5.32, 309, 30, 65.37, 0.1548), 'The parcel went to 65 Harrowgate Lane, Oxlinton DM3 2QX. By then, the | '),
    (0, 14544, (0.02257, 14.44, 0.1111, 0.419, 5.564, 179, 18, 65.56, 0.1487), 'That pickled match followed their hostel without the tenant since | some'),
    (0, 17851, (0.02266, 11.74, 0.1852, 0.4231, 5.43, 286, 27, 68.26, 0.1498), 'The segmenter delivered her remote score through their annual plank. The'),
    (0, 18762, (0.02994, 24.29, 0.2857, 0.4286, 5.143, 63, 7, 55.71, 0.1587), 'On the whole, the curious contract covered the tidy maple, because the |'),
    (0, 10021, (0.02073, 24.38, 0.25, 0.4179, 5.642, 67, 8, 55.62, 0.1479), 'The raincoat pruned the doctor. At first, this sparse stamp measured | h'),
    (0, 18064, (0.02419, 25.88, 0.125, 0.4493, 5.261, 69, 8, 54.12, 0.1545), 'This time, the forklift pruned her rusty doctor between a | header? That'),
    (0, 20741, (0.02315, 24.33, 0.3333, 0.3846, 5.41, 78, 9, 55.67, 0.1546), 'The curtain scanned another merge over this faulty notebook. My | compac'),
    (0, 11749, (0.03516, 19.2, 0.2, 0.3878, 5.041, 49, 5, 60.8, 0.1688), 'Das Fahrrad der Stadt erwähnte der Turm neben die Wiese. Der Hafen liefe'),
    (0, 26405, (0.01947, 22.28, 0.2778, 0.4511, 4.652, 184, 18, 57.72, 0.1733), 'Die Treppe vom Nachbarn baute das Ergebnis von nebenan hinter der | Vers'),
    (0, 7808, (0.02387, 19.21, 0.2083, 0.4701, 4.425, 268, 24, 60.79, 0.1824), 'El faro revisó la escalera casi nunca. La montaña observó la maestra | s'),
]
