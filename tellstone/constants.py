"""Word lists, patterns, orders and weights that results depend on."""

from __future__ import annotations

# Motifs, each with its archetype and pattern. Patterns apply to lower-cased text, ignoring case.
MOTIFS = [
    ("MOTIF-FLOOD", "FLOOD_NARRATIVE", r"(flood|deluge|inundation|abubu|great flood|waters? rose)"),
    ("MOTIF-ARK", "FLOOD_NARRATIVE", r"(ark|boat|vessel|ship|massartu|hulug|build.*(boat|ship))"),
    ("MOTIF-FLOOD-HERO", "FLOOD_NARRATIVE", r"(Utnapishtim|Ziusudra|Atrahasis|Noah|flood hero|was warned)"),
    ("MOTIF-DOVES", "FLOOD_NARRATIVE", r"(dove|swallow|raven|bird.*(released|sent|returned))"),
    ("MOTIF-FLOOD-SACRIFICE", "FLOOD_NARRATIVE", r"(sacrifice|offering|incense|libation|gods smelled|sweet savor)"),
    ("MOTIF-RAINBOW-COVENANT", "FLOOD_NARRATIVE", r"(covenant|promise|never again|rainbow|bow in cloud)"),
    ("MOTIF-GODS-COUNCIL", "DIVINE_COUNCIL", r"(assembly|council|gods gathered|divine council|ukkin|puhru)"),
    ("MOTIF-ENLIL-WRATH", "DIVINE_COUNCIL", r"(Enlil (angry|wrath)|noise of mankind|disturbed Enlil)"),
    ("MOTIF-EA-WARNING", "DIVINE_COUNCIL", r"(Ea warned|Enki whispered|reed wall|secretly told)"),
    ("MOTIF-HERO-QUEST", "HERO_JOURNEY", r"(journey|quest|traveled|went forth|undertook)"),
    ("MOTIF-PLANT-OF-IMMORTALITY", "IMMORTALITY_QUEST", r"(plant of (life|immortality)|herb of immortality|sammu sa bal|thorny plant)"),
    ("MOTIF-PLANT-LOST", "IMMORTALITY_QUEST", r"(serpent stole|snake took|plant lost|stolen by|water carried)"),
    ("MOTIF-ENKIDU-DEATH", "HERO_JOURNEY", r"(Enkidu (died|death)|friend died|companion perished)"),
    ("MOTIF-GILGAMESH-GRIEF", "HERO_JOURNEY", r"(Gilgamesh wept|fear of death|terrified of death|how can I rest)"),
    ("MOTIF-URSHANABI", "HERO_JOURNEY", r"(Urshanabi|ferryman|boatman|cross the water|waters of death)"),
    ("MOTIF-SIDURI", "HERO_JOURNEY", r"(Siduri|tavern keeper|ale wife|enjoy life|fill your belly)"),
    ("MOTIF-CLAY-CREATION", "CREATION", r"(clay|mud|mixed with blood|created mankind|pinched off clay)"),
    ("MOTIF-GODS-REBELLION", "CREATION", r"(gods rebelled|work was heavy|complained|went on strike|refused)"),
    ("MOTIF-WE-ILA", "CREATION", r"(We-ila|womb goddess|Nintu|midwife|assisted creation)"),
    ("MOTIF-KINGSHIP-DESCENDED", "CIVILIZATION", r"(kingship descended|kingship from heaven|nam-lugal|me descended)"),
    ("MOTIF-FIRST-CITIES", "CIVILIZATION", r"(Eridu|Uruk|Bad-tibira|Larsa|Sippar|first cities)"),
    ("MOTIF-ME-GIFTS", "CIVILIZATION", r"\bme\b|divine gifts|arts of civilization|decrees|Inanna.*me"),
    ("MOTIF-UNDERWORLD-JOURNEY", "AFTERLIFE", r"(underworld|netherworld|Kur|Irkalla|descended to|land of no return)"),
    ("MOTIF-ISHTAR-DESCENT", "AFTERLIFE", r"(Inanna descended|Ishtar descended|seven gates|stripped|Ereshkigal)"),
    ("MOTIF-MARDUK-TIAMAT", "CHAOSKAMPF", r"(Marduk.*Tiamat|Tiamat.*Marduk|defeated Tiamat|split.*body)"),
    ("MOTIF-NINURTA-ASAG", "CHAOSKAMPF", r"(Ninurta.*Asag|Asag.*Ninurta|defeated Asag|Sharur)"),
]

# Periods in their order. LB stands before NA.
PERIODS = ["ED", "EDIII", "OLD_AKKADIAN", "URIII", "OB", "MB", "LB", "NA", "NB", "ACH", "UNKNOWN"]
UNKNOWN_PERIOD = 99

# Labels and the markers any of which gives them.
MYTH_LABELS = {
    "gilgamesh": ["gilgamesh", "bilgames", "ḫumbaba", "enkidu", "utnapishtim", "šiduri"],
    "atrahasis": ["atrahasis", "atra-ḫasis", "eṭemmu", "ellil", "belet-ili", "nintu"],
    "enuma_elish": ["enuma elish", "enu eliš", "marduk", "tiamat", "apsu", "kingu", "mummu"],
    "inanna_ishtar": ["inanna", "ishtar", "ereškigal", "dumuzi", "geshtinanna", "ninshubur"],
    "flood": ["zondvloed", "flood", "deluge", "ark", "boat", "bird", "raven", "dove", "utnapishtim", "ziudsudra", "atisrahasis"],
    "immortality": ["onsterfelijkheid", "immortality", "life", "death", "plant", "snake", "rejuvenation"],
    "divine_council": ["goddelijke raad", "divine council", "assembly", "anunnaki", "igigi", "enlil", "an", "enkidu"],
    "descent": ["onderwereld", "underworld", "descent", "kur", "ereškigal", "namtar"],
}
NO_LABEL = "uncategorized"

# Motif groups of the reconstruction and their key words.
MOTIF_GROUPS = {
    "Zondvloed": ["a-bu-bi", "zi-us-du-ra", "ut-napish-tim", "flood", "deluge", "ark", "boat"],
    "Godenraad": ["din-gir", "ilāni", "anunnaki", "gods", "council", "assembly", "enlil", "ea"],
    "Schepping": ["e-nu-ma", "e-liš", "creation", "heaven", "earth", "apsu", "tiamat"],
    "Onderwereld": ["kur", "ir-kal-la", "underworld", "netherworld", "ereškigal", "n галел"],
    "Held": ["gilgameš", "gilgamesh", "en-kid-du", "enkidu", "hero", "king"],
    "Rituelen": ["šu-il-la", "incantation", "ritual", "prayer", "offering", "sacrifice"],
    "Koningschap": ["lugal", "šarru", "king", "royal", "throne", "crown", "scepter"],
    "Sterrenkunde": ["mul", "kakkab", "star", "planet", "venus", "moon", "sun", "observation"],
}
NO_MOTIF_GROUP = "Onbekend/Thema niet gedetecteerd"

# The first class with a marker in the text wins.
LANGUAGES = [
    ("Sumerian", ["d", "mu", "lugal", "ensi", "nin", "dam", "dumu", "e2", "gu4", "udu", "szita", "kug", "babbar"]),
    ("Akkadian", ["šumma", "ana", "adi", "eli", "itti", "ina", "awīlum", "wardum", "amtum", "bēlum", "qātum"]),
    ("Hittite", ["ezza", "tan", "pala", "wapp", "kari", "dāi", "ešzi", "kuwapi", "natta", "šar"]),
]
PERIOD_MARKERS = [
    ("Old Babylonian", ["old babylonian", "ob"]),
    ("Neo-Assyrian", ["neo-assyrian", "na"]),
    ("Neo-Babylonian", ["neo-babylonian", "nb"]),
    ("Ur III / Sumerian", ["sumerian", "ur iii"]),
    ("Hittite Empire", ["hittite", "boğazköy"]),
]
GENRES = [
    ("Myth/Epic", ["epic", "myth", "legend", "gilgamesh", "atrahasis", "enuma", "inanna", "descent"]),
    ("Ritual/Hymn", ["hymn", "prayer", "ritual", "incantation"]),
    ("Administrative", ["letter", "contract", "legal", "economic", "administrative"]),
    ("Lexical", ["lexical", "list", "vocabulary", "syllabary"]),
]

# Rule templates for signs in context: pattern, reading, part of speech, priority.
RULE_TEMPLATES = [
    (r"^(DINGIR|AN)\.(?!\.)", "", "X", 100),
    (r"\.(KI|URU)$", "", "X", 90),
    (r"^GIŠ\.(?!\.)", "", "X", 80),
    (r"\.MEŠ$", "", "X", 70),
    (r"LUGAL\.KALAM", "lugal.kalam", "N", 95),
    (r"LUGAL\.UGU", "lugal.ugu", "N", 95),
    (r"NAM\.LUGAL", "nam.lugal", "N", 95),
    (r"EN\.LIL", "en.lil2", "PN", 95),
    (r"EN\.KI", "en.ki", "PN", 95),
    (r"E2\.GAL", "e2.gal", "N", 90),
    (r"E2\.DUB\.BA", "e2.dub.ba", "N", 90),
    (r"E2\.KUR\.RA", "e2.kur.ra", "N", 90),
    (r"URU\.SAG", "uru.sag", "N", 90),
    (r"URU\.KI", "uru.ki", "N", 90),
    (r"AN\.KI", "an.ki", "N", 95),
    (r"AN\.NA", "an.na", "ADV", 85),
    (r"DINGIR\.GAL", "dingir.gal", "N", 90),
    (r"DINGIR\.MEŠ", "dingir.meš", "N", 90),
    (r"KI\.GAL", "ki.gal", "N", 85),
    (r"KI\.EN\.GI", "ki.en.gi", "GN", 95),
    (r"MA\.AN\.SUM", "ma.an.sum", "DN", 80),
    (r"MA\.GAN", "ma.gan", "N", 80),
    (r"NI\.GUR", "ni.gur", "V", 85),
    (r"NI\.TA", "ni.ta", "N", 85),
    (r"EN\.GAG", "en.gag", "N", 85),
    (r"A\.GAL", "a.gal", "N", 80),
    (r"A\.NUN", "a.nun", "N", 80),
    (r"A\.ZU", "a.zu", "N", 80),
]

# Compound signs; components are the parts between the stops.
COMPOUNDS = [
    "SAG.DU", "KA.DUB", "UD.UNUG", "LUGAL.KALAM.MA", "EN.LIL", "EN.KI", "NIN.HUR", "DINGIR.NIN.LIL",
    "E2.GAL", "E2.DUB.BA", "AN.NA", "KI.EN.GI", "URU.SAG", "MA.AN.SUM", "NIN.DA",
]

# Kinds, types and thresholds.
EMBEDDING_TYPES = ["text_sbert", "text_tfidf_svd", "visual_orb", "visual_bovw"]
ENTRY_TYPES = ["tablet", "corpus_catalog", "myth_text"]
SIGN_TYPES = ["wedge", "vertical", "horizontal", "angled", "complex"]
OVERLAP_LIMIT = 0.3
PRESENT = 0.5
NEIGHBOUR_LEAST, EDGE_LEAST = 0.3, 0.65
JOIN_WEIGHTS = (0.3, 0.5, 0.2)
HYBRID_WEIGHTS = (0.6, 0.4)
