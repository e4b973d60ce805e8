"""Text rules of names and queries as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: word lists, phrases and patterns of the query language --------------------------------------
COLOR_WORDS = {"white": "W", "blue": "U", "black": "B", "red": "R", "green": "G", "colorless": "Colorless"}
VALUE_WORDS = [
    (["cheap", "small", "low mana", "low cost"], ["CMC_0", "CMC_1", "CMC_2", "CMC_3"]),
    (["medium mana", "mid"], ["CMC_4", "CMC_5"]),
    (["big", "expensive", "high mana"], ["CMC_6", "CMC_7_plus"]),
]
IRREGULAR = {"elves": "elf", "wolves": "wolf", "dwarves": "dwarf", "knives": "knife"}
SYNONYMS = {
    "punish": "hate", "punishing": "hate", "hoser": "hate", "hose": "hate", "hosing": "hate",
    "steal": "theft", "stealing": "theft", "stolen": "theft", "stole": "theft",
    "blink": "flicker", "blinking": "flicker", "wrath": "sweeper", "boardwipe": "sweeper",
    "make": "create", "making": "create", "made": "create", "creating": "create",
    "generate": "create", "generating": "create", "produce": "create", "producing": "create",
    "double": "doubler", "doubling": "doubler", "tutoring": "tutor",
}
ALSO = {"hate": ["removal"]}
FILLER = ["a", "an", "the", "of", "to", "for", "with", "and", "or", "that", "my", "your", "their", "its", "it", "is", "are", "on", "in"]
AMBIGUOUS = ["counter"]
PHRASES = [
    (r"\bnon[- ]+(?=[a-z])", "non"),
    (r"\bsearch(?:es|ing)?\b[^.]*?\blibrar(?:y|ies)\b", "tutor"),
    (r"\bcan(?:no|')?t (?:cast|play)\b", "silence"),
    (r"\bwins? the game\b", "win condition"),
    (r"\bland destruction\b", "land removal"),
    (r"\bkill spells?\b", "creature removal"),
    (r"\b(?:mana )?dorks?\b", "mana dork"),
    (r"\btoken makers?\b", "makes tokens"),
    (r"\bdiscards? (?:\w+ )?hands? and draws?\b", "wheel"),
    (r"\bwhen(?:ever)?\b[^.]*?\bdies\b", "death trigger"),
]
TYPE_WORDS = ["land", "creature", "artifact", "enchantment", "instant", "sorcery", "planeswalker", "battle"]
PRICE = (r"(?:under|below|less than|cheaper than|max|<=?)\s*(?:[a-z]{0,2}[$€£¥])\s*(\d+(?:\.\d+)?)"
         r"|[$€£¥](\d+(?:\.\d+)?)\s*(?:or less|or under|max)"
         r"|(?:under|below|less than)\s*(\d+(?:\.\d+)?)\s*(?:dollars|bucks|euros|pounds|yen)")
JARGON = (r"\b(cycle|synergy|pwdeck|deprecated|mv|cmc|typal|tribal|set|sets|mechanic|precon|named|errata|matters|self|card|oracle|"
          r"unprinted|deck)\b|\d")
# -----------------------------------------------------------------------------------------------------------------


@lru_cache
def _accents() -> tuple[str, str]:
    """Letters that Unicode decomposes into one base letter and marks, and those base letters."""
    letters, bases = [], []
    for code in range(0xC0, min(sys.maxunicode, 0xFFFF)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.category(p).startswith("M") for p in parts[1:]):
            letters.append(chr(code))
            bases.append(parts[0])
    return "".join(letters), "".join(bases)


def fold(name: Column) -> Column:
    """Accents off, lower case, straight quotes, trimmed: two spellings of a name meet. Stays in the JVM."""
    letters, bases = _accents()
    bare = F.regexp_replace(F.translate(name, letters, bases), r"\p{M}", "")
    return F.trim(F.translate(F.lower(bare), "’`", "''"))


def fold_key(name: Column) -> Column:
    """Only the letters and digits of a folded name."""
    return F.regexp_replace(fold(name), "[^a-z0-9]", "")


def lookup(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def normalise(text: Column) -> Column:
    text = F.lower(text)
    for pattern, to in PHRASES:
        text = F.regexp_replace(text, pattern, to)
    return F.replace(text, F.lit("'"), F.lit(""))


def raw_words(text: Column) -> Column:
    return F.filter(F.split(normalise(text), "[^a-z0-9]+"), lambda w: w != "")


def stem(w: Column) -> Column:
    """Singular of a word, then its everyday synonym."""
    n = F.length(w)
    cut = lambda k: F.substring(w, 1, n - k)
    plain = (F.when((n > 4) & w.endswith("ies"), F.concat(cut(3), F.lit("y")))
             .when((n > 4) & w.rlike("(ss|sh|ch|x|z)es$"), cut(2))
             .when((n > 3) & w.endswith("s") & ~w.rlike("(ss|us|is)$"), cut(1)).otherwise(w))
    said = F.coalesce(lookup(SYNONYMS)[plain], plain)
    return F.coalesce(lookup(IRREGULAR)[w], said)


def words(text: Column) -> Column:
    return F.transform(F.filter(raw_words(text), lambda w: ~w.isin(FILLER)), stem)


def spoken_price(query: Column) -> Column:
    """A price limit said in a query with a currency sign or word; null where there is none."""
    low = F.lower(query)
    found = [F.nullif(F.regexp_extract(low, PRICE, g), F.lit("")) for g in (1, 2, 3)]
    return F.coalesce(*found).try_cast("double")


def price_limit(query: Column, rate: Column | float = 1.0, budget: float = 1.0) -> Column:
    """The limit in dollars: what the query says over the currency's rate, or a dollar for "budget"."""
    rate = F.lit(rate) if isinstance(rate, float) else rate
    return F.coalesce(spoken_price(query) / rate, F.when(query.rlike(r"(?i)\bbudget\b"), F.lit(budget)))


def forms(term: Column) -> Column:
    """The spellings a phrase is matched in: itself, with s or es, and f as ve."""
    low = F.lower(term)
    bases = F.when(low.endswith("f"), F.array(low, F.concat(F.substring(low, 1, F.length(low) - 1), F.lit("ve")))).otherwise(F.array(low))
    return F.array_distinct(F.flatten(F.transform(bases, lambda b: F.array(b, F.concat(b, F.lit("s")), F.concat(b, F.lit("es"))))))
