"""Column functions on language tags, and the tables behind language identification."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from cuewright.functions.text import SPACE, once

# fixed values: three-letter codes
THREE_TO_TWO = {
    "eng": "en", "spa": "es", "fre": "fr", "fra": "fr", "ger": "de",
    "deu": "de", "ita": "it", "por": "pt", "dut": "nl", "nld": "nl",
    "swe": "sv", "nor": "no", "nob": "no", "dan": "da", "fin": "fi",
    "pol": "pl", "cze": "cs", "ces": "cs", "slo": "sk", "slk": "sk",
    "rum": "ro", "ron": "ro", "hun": "hu", "tur": "tr", "rus": "ru",
    "ukr": "uk", "gre": "el", "ell": "el", "ara": "ar", "heb": "he",
    "hin": "hi", "tha": "th", "jpn": "ja", "kor": "ko", "chi": "zh",
    "zho": "zh", "vie": "vi", "ind": "id", "may": "ms", "msa": "ms",
    "bul": "bg", "hrv": "hr", "srp": "sr", "slv": "sl", "est": "et",
    "lav": "lv", "lit": "lt", "cat": "ca", "fas": "fa", "per": "fa",
}
# fixed values: names
NAMES = {
    "en": "English", "es": "Spanish", "fr": "French", "de": "German",
    "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "sv": "Swedish",
    "no": "Norwegian", "da": "Danish", "fi": "Finnish", "pl": "Polish",
    "cs": "Czech", "sk": "Slovak", "ro": "Romanian", "hu": "Hungarian",
    "tr": "Turkish", "ru": "Russian", "uk": "Ukrainian", "el": "Greek",
    "ar": "Arabic", "he": "Hebrew", "hi": "Hindi", "th": "Thai",
    "ja": "Japanese", "ko": "Korean", "zh": "Chinese", "vi": "Vietnamese",
    "id": "Indonesian", "ms": "Malay", "bg": "Bulgarian", "hr": "Croatian",
    "sr": "Serbian", "sl": "Slovenian", "et": "Estonian", "lv": "Latvian",
    "lt": "Lithuanian", "ca": "Catalan", "fa": "Persian",
}
# fixed values: function words by language; ``profiles`` of the operators replaces them
PROFILES = {
    "en": ["the", "and", "you", "that", "was", "with", "this", "have", "not", "for", "but", "what"],
    "es": ["que", "de", "no", "la", "el", "en", "es", "por", "una", "con", "para", "está"],
    "pt": ["que", "não", "de", "uma", "com", "por", "para", "você", "está", "isso", "mas", "ele"],
    "fr": ["que", "les", "des", "est", "pas", "vous", "pour", "dans", "une", "qui", "avec", "elle"],
    "it": ["che", "non", "per", "una", "con", "sono", "come", "questo", "della", "anche", "più", "cosa"],
    "de": ["und", "der", "die", "das", "ist", "nicht", "sie", "mit", "ich", "auf", "ein", "wir"],
    "nl": ["het", "een", "van", "dat", "niet", "voor", "met", "maar", "zijn", "heb", "wat", "naar"],
    "sv": ["och", "att", "det", "som", "inte", "för", "med", "har", "jag", "vi", "men", "här"],
    "da": ["og", "det", "ikke", "til", "med", "har", "jeg", "var", "hun", "men", "hvad", "kan"],
    "no": ["og", "det", "ikke", "til", "med", "har", "jeg", "var", "hun", "men", "hva", "kan"],
    "fi": ["että", "ei", "on", "ja", "se", "mutta", "niin", "hän", "kun", "olen", "sinä", "tämä"],
    "pl": ["nie", "się", "jest", "tak", "ale", "jak", "tego", "przez", "czy", "tylko", "wszystko", "bardzo"],
    "cs": ["ale", "jsem", "jak", "tak", "co", "když", "jsi", "byl", "všechno", "protože", "jenom", "tady"],
    "sk": ["som", "ale", "ako", "keď", "všetko", "prečo", "tam", "bol", "iba", "veľmi", "musíme", "tu"],
    "ro": ["este", "care", "pentru", "din", "sunt", "dar", "cu", "nu", "așa", "acum", "ceva", "bine"],
    "hu": ["hogy", "nem", "egy", "van", "meg", "csak", "már", "még", "ez", "mit", "kell", "volt"],
    "tr": ["bir", "bu", "için", "ama", "değil", "çok", "ne", "gibi", "daha", "olarak", "var", "şey"],
    "el": ["και", "να", "που", "δεν", "για", "με", "θα", "είναι", "στο", "από", "αλλά", "μου"],
    "ru": ["не", "что", "это", "как", "но", "тебя", "меня", "мы", "они", "так", "все", "если"],
    "uk": ["не", "що", "це", "як", "але", "тебе", "мене", "ми", "вони", "так", "все", "якщо"],
    "bg": ["не", "да", "се", "на", "ще", "аз", "той", "но", "как", "това", "тук", "защо"],
    "id": ["yang", "tidak", "dan", "ini", "untuk", "dengan", "itu", "kamu", "saya", "kita", "sudah", "bisa"],
    "vi": ["không", "của", "một", "những", "được", "người", "này", "tôi", "chúng", "anh", "cho", "đã"],
    "ca": ["que", "amb", "això", "però", "una", "els", "per", "és", "molt", "aquest", "aquí", "res"],
}
# fixed values: letters that set a language apart
SIGNATURES = {
    "uk": ["і", "ї", "є", "ґ"],
    "ru": ["ы", "э", "ъ"],
    "pl": ["ł", "ż", "ę", "ą", "ś", "ń"],
    "cs": ["ř", "ů", "ě"],
    "sk": ["ľ", "ĺ", "ŕ"],
    "hu": ["ő", "ű"],
    "ro": ["ș", "ț", "ă"],
    "tr": ["ğ", "ı", "ş"],
    "es": ["ñ", "¿", "¡"],
    "pt": ["ã", "õ", "ç"],
    "de": ["ß"],
    "da": ["æ", "ø"],
    "no": ["æ", "ø"],
    "sv": ["å", "ä", "ö"],
    "fi": ["ä", "ö"],
    "vi": ["ơ", "ư", "đ"],
}
# fixed values: scripts in the order of the test, with their ranges
SCRIPTS = [
    ("ko", r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]"),
    ("ja", r"[\x{3040}-\x{30FF}]"),
    ("zh", r"[\x{4E00}-\x{9FFF}]"),
    ("th", r"[\x{0E00}-\x{0E7F}]"),
    ("ar", r"[\x{0600}-\x{06FF}]"),
    ("he", r"[\x{0590}-\x{05FF}]"),
    ("hi", r"[\x{0900}-\x{097F}]"),
]
#: Lead of a guess over the tag; fewest words; boost of a signature; fewest letters of a script.
CONTRADICTION, LEAST_WORDS, BOOST, LEAST_LETTERS = 2.5, 40, 1.6, 20


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])


def normalized(tag: Column) -> Column:
    """A two-letter code of a tag: region cut off, three letters and English names translated; '' without a tag."""
    bare = F.regexp_replace(F.coalesce(tag, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    low = F.lower(F.regexp_replace(bare, "^([^-_]+)[-_].*$", "$1"))
    by_name = {name.lower(): code for code, name in NAMES.items()}
    known = F.try_element_at(_map(THREE_TO_TWO | by_name), low)
    return F.when(F.length(low) == 2, low).otherwise(F.coalesce(known, low))


def language_name(tag: Column) -> Column:
    code = normalized(tag)
    return F.when(code == "", "untagged").otherwise(F.coalesce(F.try_element_at(_map(NAMES), code), code))


def same_language(a: Column, b: Column) -> Column:
    left = normalized(a)
    return (left != "") & (left == normalized(b))


def described(code: Column, score: Column) -> Column:
    """``Spanish (31%)``."""
    return F.concat(language_name(code), F.lit(" ("), F.bround(score * 100, 0).cast("int").cast("string"), F.lit("%)"))


def script(text: Column) -> Column:
    """The language of a text by its script, or null: letters of one script beyond a tenth of at least 20."""
    # letters of the block alone count; signs and digits of it do not
    count = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))

    def chosen(letters: Column) -> Column:
        found = F.lit(None).cast("string")
        for code, block in reversed(SCRIPTS):
            found = F.when(count(f"(?=\\p{{L}}){block}") > F.floor(letters / 10), code).otherwise(found)
        return F.when(letters >= LEAST_LETTERS, found)

    # nothing is counted in a text without a character of these blocks
    return F.when(text.rlike("[" + "".join(block[1:-1] for _, block in SCRIPTS) + "]"), once(count(r"\p{L}"), chosen))
