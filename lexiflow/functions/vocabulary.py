"""Controlled vocabularies and language codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The labels of dial in their order, one a line.
DIALECTS = """
Brazilian
Hokkaido-ben
Kansai-ben
Kantou-ben
Kyoto-ben
Kyuushuu-ben
Nagano-ben
Osaka-ben
Ryuukyuu-ben
Touhoku-ben
Tosa-ben
Tsugaru-ben
""".strip().split("\n")

# The labels of field in their order, one a line.
FIELDS = """
agriculture
anatomy
archeology
architecture
art, aesthetics
astronomy
audiovisual
aviation
baseball
biochemistry
biology
botany
boxing
Buddhism
business
card games
chemistry
Chinese mythology
Christianity
civil engineering
clothing
computing
crystallography
dentistry
ecology
economics
electricity, elec. eng.
electronics
embryology
engineering
entomology
figure skating
film
finance
fishing
food, cooking
gardening, horticulture
genetics
geography
geology
geometry
go (game)
golf
grammar
Greek mythology
hanafuda
horse racing
Internet
Japanese mythology
kabuki
law
linguistics
logic
martial arts
mahjong
manga
mathematics
mechanical engineering
medicine
meteorology
military
mineralogy
mining
motorsport
music
noh
ornithology
paleontology
pathology
pharmacology
philosophy
photography
physics
physiology
politics
printing
professional wrestling
psychiatry
psychoanalysis
psychology
railway
Roman mythology
Shinto
shogi
skiing
sports
statistics
stock market
sumo
surgery
telecommunications
trademark
television
veterinary terms
video games
zoology
""".strip().split("\n")

# The labels of ke_inf in their order, one a line.
KANJI_NOTES = """
ateji (phonetic) reading
ateji (semantic) reading
gikun (meaning) reading
jukujikun reading
nanori reading
okurigana irregularity
irregular okurigana
search-only kanji form
rarely used kanji form
word usually written using kanji alone
word usually written using kana alone
word containing irregular kana usage
word containing irregular kanji usage
irregular okurigana usage
word containing out-dated kanji or kanji usage
""".strip().split("\n")

# The labels of misc in their order, one a line.
MISC = """
abbreviation
archaic
character
children's language
colloquial
company name
creature
dated term
deity
derogatory
document
euphemistic
event
familiar language
female term or language
fiction
formal or literary term
given name or forename, gender not specified
group
historical term
honorific or respectful (sonkeigo) language
humble (kenjougo) language
idiomatic expression
jocular, humorous term
legend
manga slang
male term or language
mythology
Internet slang
object
obsolete term
onomatopoeic or mimetic word
organization name
other
full name of a particular person
place name
poetical term
polite (teineigo) language
product name
proverb
quotation
rare term
religion
sensitive
service
ship name
slang
railway station
family or surname
word usually written using kana alone
unclassified name
vulgar expression or word
work of art, literature, music, etc. name
rude or X-rated term (not displayed in educational software)
yojijukugo
""".strip().split("\n")

# The labels of pos in their order, one a line.
PARTS_OF_SPEECH = """
noun or verb acting prenominally
adjective (keiyoushi)
adjective (keiyoushi) - yoi/ii class
'kari' adjective (archaic)
'ku' adjective (archaic)
adjectival nouns or quasi-adjectives (keiyodoshi)
archaic/formal form of na-adjective
nouns which may take the genitive case particle 'no'
pre-noun adjectival (rentaishi)
'shiku' adjective (archaic)
'taru' adjective
adverb (fukushi)
adverb taking the 'to' particle
auxiliary
auxiliary adjective
auxiliary verb
conjunction
copula
counter
expressions (phrases, clauses, etc.)
interjection (kandoushi)
noun (common) (futsuumeishi)
adverbial noun (fukushitekimeishi)
proper noun
noun, used as a prefix
noun, used as a suffix
noun (temporal) (jisoumeishi)
numeric
pronoun
prefix
particle
suffix
unclassified
verb unspecified
Ichidan verb
Ichidan verb - kureru special class
Nidan verb with 'u' ending (archaic)
Nidan verb (upper class) with 'bu' ending (archaic)
Nidan verb (lower class) with 'bu' ending (archaic)
Nidan verb (upper class) with 'dzu' ending (archaic)
Nidan verb (lower class) with 'dzu' ending (archaic)
Nidan verb (upper class) with 'gu' ending (archaic)
Nidan verb (lower class) with 'gu' ending (archaic)
Nidan verb (upper class) with 'hu/fu' ending (archaic)
Nidan verb (lower class) with 'hu/fu' ending (archaic)
Nidan verb (upper class) with 'ku' ending (archaic)
Nidan verb (lower class) with 'ku' ending (archaic)
Nidan verb (upper class) with 'mu' ending (archaic)
Nidan verb (lower class) with 'mu' ending (archaic)
Nidan verb (lower class) with 'nu' ending (archaic)
Nidan verb (upper class) with 'ru' ending (archaic)
Nidan verb (lower class) with 'ru' ending (archaic)
Nidan verb (lower class) with 'su' ending (archaic)
Nidan verb (upper class) with 'tsu' ending (archaic)
Nidan verb (lower class) with 'tsu' ending (archaic)
Nidan verb (lower class) with 'u' ending and 'we' conjugation (archaic)
Nidan verb (upper class) with 'yu' ending (archaic)
Nidan verb (lower class) with 'yu' ending (archaic)
Nidan verb (lower class) with 'zu' ending (archaic)
Yodan verb with 'bu' ending (archaic)
Yodan verb with 'gu' ending (archaic)
Yodan verb with 'hu/fu' ending (archaic)
Yodan verb with 'ku' ending (archaic)
Yodan verb with 'mu' ending (archaic)
Yodan verb with 'nu' ending (archaic)
Yodan verb with 'ru' ending (archaic)
Yodan verb with 'su' ending (archaic)
Yodan verb with 'tsu' ending (archaic)
Godan verb - -aru special class
Godan verb with 'bu' ending
Godan verb with 'gu' ending
Godan verb with 'ku' ending
Godan verb - Iku/Yuku special class
Godan verb with 'mu' ending
Godan verb with 'nu' ending
Godan verb with 'ru' ending
Godan verb with 'ru' ending (irregular verb)
Godan verb with 'su' ending
Godan verb with 'tsu' ending
Godan verb with 'u' ending
Godan verb with 'u' ending (special class)
Godan verb - Uru old class verb (old form of Eru)
intransitive verb
Kuru verb - special class
irregular nu verb
irregular ru verb, plain form ends with -ri
noun or participle which takes the aux. verb suru
su verb - precursor to the modern suru
suru verb - included
suru verb - special class
transitive verb
Ichidan verb - zuru verb (alternative form of -jiru verbs)
""".strip().split("\n")

# The labels of re_inf in their order, one a line.
READING_NOTES = """
gikun (meaning as reading) or jukujikun (special kanji reading)
word containing irregular kana usage
out-dated or obsolete kana usage
rarely used kana form
search-only kana form
""".strip().split("\n")

# Priority marks in their order; the last 48 are frequency bands.
PRIORITIES = ["news1", "news2", "ichi1", "ichi2", "spec1", "spec2", "gai1", "gai2", *(f"nf{i:02d}" for i in range(1, 49))]

VOCABULARIES = {
    "dial": DIALECTS, "field": FIELDS, "ke_inf": KANJI_NOTES, "misc": MISC, "pos": PARTS_OF_SPEECH,
    "re_inf": READING_NOTES, "pri": PRIORITIES,
}

# Language codes in their order, each with the ISO 639-2 codes that mean it.
LANGUAGES = {
    "en": "eng", "fr": "fra fre", "de": "deu ger", "ru": "rus", "es": "spa", "pt": "por", "it": "ita", "nl": "nld dut",
    "hu": "hun", "sv": "swe", "cs": "ces cze", "pl": "pol", "ro": "ron rum", "he": "heb", "ar": "ara", "tr": "tur",
    "th": "tha", "vi": "vie", "id": "ind", "ms": "msa", "ko": "kor", "zh": "zho wuu nan hak", "zh-cn": "cmn", "zh-tw": "yue",
    "fa": "fas per", "eo": "epo", "slv": "slv", "unk": "",
}
#: Languages that have a gloss index.
INDEXED = ("en", "es", "fr", "de", "hu", "nl", "ru", "slv", "sv")
#: Marks that make an entry common, beside every frequency band.
COMMON = ("news1", "news2", "ichi1", "ichi2", "spec1", "spec2", "gai1", "gai2")


def tokens(spark: SparkSession) -> DataFrame:
    """(kind, idx, label): all labels, from 0 in each vocabulary. A few hundred rows by definition."""
    rows = [(k, i, label) for k, labels in VOCABULARIES.items() for i, label in enumerate(labels)]
    return spark.createDataFrame(rows, "kind string, idx int, label string")


def encode(label: Column, kind: str) -> Column:
    """Place of the label in its vocabulary; null if it has none."""
    at = F.array_position(F.lit(VOCABULARIES[kind]), label)
    return F.when(at > 0, at - 1).cast("int")


def decode(idx: Column, kind: str) -> Column:
    return F.when(idx >= 0, F.get(F.lit(VOCABULARIES[kind]), idx))


def languages(spark: SparkSession) -> DataFrame:
    """(ordinal, lang)."""
    return spark.createDataFrame(list(enumerate(LANGUAGES)), "ordinal int, lang string")


def language_of(iso: Column) -> Column:
    """Code of an ISO 639-2 language; English where none is given, ``unk`` where it is not known."""
    code = F.coalesce(*[F.when(iso.isin(isos.split()), F.lit(lang)) for lang, isos in LANGUAGES.items() if isos], F.lit("unk"))
    return F.when(iso.isNull(), F.lit("en")).otherwise(code)


def is_common(priorities: Column) -> Column:
    """1 if any mark in the array says so."""
    return F.exists(priorities, lambda p: p.isin(*COMMON) | p.startswith("nf")).cast("int")
