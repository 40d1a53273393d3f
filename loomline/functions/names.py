"""Names as Columns: identifiers, semantic normal forms, word forms, similarities and the score."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from loomline.plans.config import SemanticConfig

#: Irregular plurals.
IRREGULAR = {"children": "child", "people": "person", "men": "man", "women": "woman", "teeth": "tooth", "feet": "foot", "mice": "mouse", "geese": "goose"}
#: Letters that stand for several.
LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}
SINGLE = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ı": "i"}


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_identifier(name: Column) -> Column:
    """snake_case of ASCII letters and digits: other characters go, separators and case changes become one ``_``."""
    kept = F.regexp_replace(F.trim(name), r"[^A-Za-z0-9 \-./\\_]", "")
    split = F.regexp_replace(kept, "([a-z0-9])(?=[A-Z])", "$1_")
    return F.regexp_replace(F.regexp_replace(F.lower(split), r"[ \-./\\_]+", "_"), "^_+|_+$", "")


#: Greek and Cyrillic letters, each with the Latin ones that stand for it.
SCRIPTS = dict(
    zip(
        "αβγδεζηθικλμνξοπρσςτυφχψωабвгдезийклмнопрстуфхыэёжцчшщъьюяєіїґ",
        "a b g d e z e th i k l m n x o p r s s t u ph kh ps o a b v g d e z i i k l m n o p r s t u f kh y e io zh ts ch sh shch \" ' iu ia ie i yi g".split(),
        strict=True,
    )
)


def _accents() -> tuple[str, str]:
    """Letters with marks and their plain forms, from their decompositions, and letters of other scripts that one letter stands for."""
    plain = dict(SINGLE)
    for letter, latin in SCRIPTS.items():
        if len(latin) == 1:
            plain |= {letter: latin, letter.upper(): latin.upper()}
    for p in range(0x370, 0x400):
        base = unicodedata.normalize("NFD", chr(p))
        if len(base) > 1 and base[0] in plain:
            plain.setdefault(chr(p), plain[base[0]])
    for p in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFKD", chr(p))[0]
        if base.isascii() and base.isalpha():
            plain.setdefault(chr(p), base)
    return "".join(plain) + "".join(map(chr, range(0x300, 0x370))), "".join(plain.values())


def transliterate(text: Column) -> Column:
    several = {k: v for k, v in SCRIPTS.items() if len(v) > 1}
    for letter, plain in (LIGATURES | several | {k.upper(): v.capitalize() for k, v in several.items()}).items():
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.translate(text, *_accents())


@pandas_udf(StringType())
def _compose(text: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize(f, t) for t, f in zip(text, form, strict=True)])


def semantic_tokens(name: Column, config: SemanticConfig) -> Column:
    text = F.trim(name)
    # once letters lose their marks the composed and decomposed forms are one
    text = transliterate(text) if config.remove_diacritics else _compose(text, F.lit(config.unicode_form))
    if config.split_camel_case:
        text = F.regexp_replace(text, r"(\p{Ll})(?=\p{Lu})", "$1 ")
    words = F.split(F.regexp_replace(F.lower(F.regexp_replace(text, r"[\-_./\\]", " ")), r"^\s+|\s+$", ""), r"\s+")
    stop = F.array(*[F.lit(w) for w in config.stopwords]).cast("array<string>")
    return F.filter(words, lambda w: (w != "") & ~F.array_contains(stop, w))


def singular(word: Column, locale: str = "en") -> Column:
    """English rules in order, the first that fits; for ``es`` a final s goes."""
    long = F.octet_length(word) >= 3
    if locale == "es":
        return F.when(long, F.regexp_replace(word, "s$", "")).otherwise(word)
    less = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    case = F.when(F.lit(False), word)
    for plural, one in IRREGULAR.items():
        case = case.when(word == plural, one)
    return (
        case.when(~long, word)
        .when(word.rlike("[^aeiou]ies$"), F.concat(less(3), F.lit("y")))
        .when(word.rlike(".ves$"), F.concat(less(3), F.lit("fe")))
        .when(word.rlike("sses$") & (F.octet_length(word) > 4), less(2))
        .when(word.rlike(".xes$"), less(2))
        .when(word.rlike(".[cs]hes$"), less(2))
        .when(word.rlike(".oes$"), less(2))
        .when(word.rlike("[^sui]s$"), less(1))
        .otherwise(word)
    )


def stemmed(word: Column, locale: str = "en") -> Column:
    case = F.when(F.octet_length(word) < 4, word)
    for suffix in ("ción", "dad", "mente") if locale == "es" else ("ing", "ed", "er", "ly"):
        fits = word.endswith(suffix) & (F.octet_length(word) > len(suffix.encode()) + 2)
        case = case.when(fits, F.substring(word, F.lit(1), F.length(word) - len(suffix)))
    return case.otherwise(word)


def morph_tokens(tokens: Column, config: SemanticConfig) -> Column:
    if config.pluralization:
        spared = F.array(*[F.lit(w) for w in config.plural_exceptions]).cast("array<string>")
        tokens = F.transform(tokens, lambda w: F.when(F.array_contains(spared, w), w).otherwise(singular(w, config.locale)))
    if config.stemming:
        tokens = F.transform(tokens, lambda w: stemmed(w, config.locale))
    return tokens


def set_similarity(a: Column, b: Column, metric: str) -> Column:
    """Jaccard or Dice of two arrays as sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    if metric == "dice":
        value = 2.0 * shared / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))
    else:
        value = shared / F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(value.cast("double"))


def ngrams(text: Column, n: int) -> Column:
    n = min(5, max(2, n))
    whole = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(whole)


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised by 0.1 for each of up to four leading characters shared if it exceeds 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, matched = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                matched.append(ch)
                break
    if not matched:
        return 0.0
    other = [ch for ch, u in zip(b, used, strict=True) if u]
    swapped = sum(x != y for x, y in zip(matched, other, strict=True)) // 2
    m = len(matched)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def damerau_levenshtein(a: str, b: str) -> int:
    """Edits with transpositions of any two characters that were adjacent."""
    last: dict[str, int] = {}
    top = len(a) + len(b)
    d = {(-1, -1): top}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = top, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = top, j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            i1, j1 = last.get(b[j - 1], 0), seen
            same = a[i - 1] == b[j - 1]
            if same:
                seen = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[i1 - 1, j1 - 1] + (i - i1 - 1) + 1 + (j - j1 - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    """``jaro_winkler`` as a Column: letters of ``b`` that are matched become a mark, which says which are left."""
    mark = F.lit("\x00")

    def matched(n: Column) -> Column:
        """struct(own: letters of a with a partner in their order, rest: b with marks), from the lengths ``n``."""

        def step(s: Column, i: Column) -> Column:
            letter = F.substring(a, i, F.lit(1))
            low = F.greatest(F.lit(1), i - n["reach"])
            at = F.instr(F.substring(s["rest"], low, i + n["reach"] - low + 1), letter)
            return F.when(at > 0, F.struct(F.concat(s["own"], letter).alias("own"), F.overlay(s["rest"], mark, low + at - 1).alias("rest"))).otherwise(s)

        return F.aggregate(F.sequence(F.lit(1), n["a"]), F.struct(F.lit("").alias("own"), b.alias("rest")), step)

    def scored(n: Column, s: Column) -> Column:
        m = F.length(s["own"])
        taken = F.filter(F.sequence(F.lit(1), n["b"]), lambda j: F.substring(s["rest"], j, F.lit(1)) == mark)
        swapped = F.size(F.filter(F.transform(taken, lambda j, i: F.substring(b, j, F.lit(1)) != F.substring(s["own"], i + 1, F.lit(1))), lambda x: x))
        jaro = (m / n["a"] + m / n["b"] + (m - F.floor(swapped / 2)) / m) / 3
        same = lambda k: F.substring(a, F.lit(1), F.lit(k)) == F.substring(b, F.lit(1), F.lit(k))
        prefix = sum((F.when(same(k) & (n["a"] >= k) & (n["b"] >= k), 1).otherwise(0) for k in range(1, 5)), F.lit(0))
        return F.when(m == 0, F.lit(0.0)).otherwise(_let(jaro, lambda j: F.when(j <= 0.7, j).otherwise(j + 0.1 * prefix * (1 - j))))

    def by_length(n: Column) -> Column:
        return _let(matched(n), lambda s: scored(n, s))

    reach = F.greatest(F.floor(F.greatest(F.length(a), F.length(b)) / 2).cast("int") - 1, F.lit(0))
    sizes = F.struct(F.length(a).alias("a"), F.length(b).alias("b"), reach.alias("reach"))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(_let(sizes, by_length)).cast("double")


@pandas_udf(DoubleType())
def damerau_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    known = {p: damerau_levenshtein(*p) for p in {(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None}}
    return pd.Series([known.get(p) for p in zip(a, b, strict=True)], dtype="float64")


def fuzzy_similarity(a: Column, b: Column, algorithm: str = "jaroWinkler") -> Column:
    """Jaro-Winkler, or one less a distance over the longer length in octets; 0 if either is empty."""
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    if algorithm == "levenshtein":
        value = 1.0 - F.levenshtein(a, b) / longest
    elif algorithm == "damerauLevenshtein":
        value = 1.0 - damerau_distance(a, b) / longest
    else:
        value = jaro_winkler_similarity(a, b)
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(value.cast("double"))


def synonym_groups(tokens: Column, config: SemanticConfig) -> Column:
    """``group:token`` of each token that belongs to a synonym group."""
    marks = F.create_map(*[F.lit(x) for g, words in enumerate(config.synonym_groups) for w in words for x in (w, g)]) if config.synonym_groups else None
    if marks is None or not config.synonyms:
        return F.array().cast("array<string>")
    return F.filter(F.transform(tokens, lambda t: F.concat_ws(":", marks[t].cast("string"), t)), lambda x: F.contains(x, F.lit(":")))


def has_synonym(a: Column, b: Column) -> Column:
    """Whether two different words, one of each side, share a group."""
    group = lambda x: F.split_part(x, F.lit(":"), F.lit(1))
    return F.exists(a, lambda x: F.exists(b, lambda y: (group(x) == group(y)) & (x != y)))


STRATEGIES = ("exact", "plural", "synonym", "token", "fuzzy", "ngram")


def score_reasons(score: Column, config: SemanticConfig) -> Column:
    """Which strategies speak for a pair: array of struct(strategy, weight, score), those without a say left out; empty unless ``explain``."""
    said = [
        F.when(score[k] > 0, F.struct(F.lit(k).alias("strategy"), F.lit(getattr(config, f"weight_{k}")).alias("weight"), score[k].cast("double").alias("score")))
        for k in STRATEGIES
    ]
    if not config.explain:
        return F.array().cast("array<struct<strategy:string,weight:double,score:double>>")
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def semantic_score(a: Column, b: Column, config: SemanticConfig) -> Column:
    """struct(score, decision, exact, plural, synonym, token, fuzzy, ngram) of two prepared names.

    ``a`` and ``b`` are structs of sem, morph and groups.  Evidence that is either there or
    not counts only where it is; measured evidence counts always.
    """
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    exact = yes(a["sem"] == b["sem"])  # two names of which nothing is left are equal too
    plural = yes(a["morph"] == b["morph"])
    synonym = yes(has_synonym(a["groups"], b["groups"])) if config.synonyms else F.lit(0.0)
    token = set_similarity(a["morph"], b["morph"], config.token_metric)
    fuzzy = fuzzy_similarity(a["sem"], b["sem"], config.fuzzy_algorithm)
    grams = set_similarity(ngrams(a["sem"], config.ngram_size), ngrams(b["sem"], config.ngram_size), config.ngram_metric)
    parts = [
        ("exact", exact, config.weight_exact, None), ("plural", plural, config.weight_plural, None), ("synonym", synonym, config.weight_synonym, None),
        ("token", token, config.weight_token, config.token_similarity), ("fuzzy", fuzzy, config.weight_fuzzy, config.fuzzy), ("ngram", grams, config.weight_ngram, config.ngrams),
    ]
    kept = F.struct(*[(v if on is not False else F.lit(0.0)).alias(k) for k, v, _, on in parts])

    def combined(s: Column) -> Column:
        top, below = F.lit(0.0), F.lit(0.0)
        for name, _, weight, on in parts:
            counts = s[name] > 0 if on is None else F.lit(bool(on))
            top = top + F.when(counts, s[name] * weight).otherwise(0.0)
            below = below + F.when(counts, F.lit(weight)).otherwise(0.0)
        score = F.when(below > 0, top / below).otherwise(0.0)
        return _let(score, lambda x: F.struct(
            x.alias("score"),
            F.when(x >= config.match_threshold, "match").when(x >= config.probable_threshold, "probable_match").otherwise("no_match").alias("decision"),
            *[s[k].alias(k) for k, *_ in parts],
        ))

    return _let(kept, combined)
