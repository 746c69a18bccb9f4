"""Quality rules with distribution divergence; DataFrame functions only.

Rules on words, symbols and repeats come first. Then a document's histogram of
character classes, and that of its language's common words, is compared with the
language's reference, the same histogram summed over all documents of the language,
by Jensen-Shannon distance. A histogram of a short document says little, so each
comparison has a least length.

op8's SQL fixes the bound of the words' distance at one constant from 100 words on. The
pipeline's filter judges by length: the distance of a random text falls with the root of
its words, so the bound is taken per language from the quartiles of their product over
all documents the rules let through; it is wider for shorter texts,
and never over that constant from 100 words on.

Counts per document are computed once and written to the shared folder; the
references are one row for each of LANGUAGES and so small by construction.

Nulls and ties: a null or empty text has no words and fails; a language that isn't
in LANGUAGES, or null, has no reference and is judged by the rules alone; rows that
repeat are judged alike and each counts in the reference; long texts are counted
whole; an empty table gives no rows; other columns pass in _row and can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm._common import materialize, packed

#: Characters, bounds and frequent words.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
UPPER, DIGIT, POINT = r"\p{Lu}", "[0-9]", r"[.,;:!?()'\"-]"
REPEAT_WORDS = 8
MIN_WORDS, MAX_REPEAT = 20, 30
LANGUAGES = {
    "en": "the of and to in is it that was for with as are be this on by he from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas".split(),
    "es": "de la que el en y los se del las un por con no una su para es al".split(),
}
#: Compared only from this length on, and rejected beyond this distance.
CHARS_FROM, MAX_CHARS_DISTANCE = 200, 0.30
WORDS_FROM, MAX_WORDS_DISTANCE = 100, 0.30
#: By length: the distance of words that is never too far, and quartile widths over the median of distance times root of length.
NEAR_WORDS, WIDTHS = 0.15, 5

CLASSES = ("c_upper", "c_digit", "c_point", "c_symbol", "c_space", "c_rest")
BINS = tuple(f"w_{i}" for i in range(max(map(len, LANGUAGES.values())))) + ("w_rest",)


def counts(docs: DataFrame, carried: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """_row (a struct of the carried columns), lang and all counts of every document."""
    text = F.coalesce(F.col(f"_{text_col}"), F.lit(""))
    d = packed(docs, text_col, lang_col).select(F.struct(*[F.col("_row")[c].alias(c) for c in carried]).alias("_row"), F.col(f"_{lang_col}").alias("lang"), text.alias("text"))
    d = d.withColumn("trimmed", F.btrim("text", F.lit(SPACE)))
    d = d.withColumn("words", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", SPACES)))
    n, w = F.size("words"), F.col("words")
    runs = F.when(n >= REPEAT_WORDS, F.transform(F.sequence(F.lit(0), n - REPEAT_WORDS), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(REPEAT_WORDS)]))).otherwise(F.array().cast("array<bigint>"))
    said = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    common = reduce(lambda at, lang: at.when(F.col("lang") == lang, F.transform(F.filter(w, lambda x: x.isin(*LANGUAGES[lang], *[y.capitalize() for y in LANGUAGES[lang]])), F.lower)), LANGUAGES, F.when(F.lit(False), F.array().cast("array<string>")))
    d = d.withColumns({"runs": runs, "said": said, "common": common, "n_words": n.cast("long"), "word_chars": F.char_length(F.array_join("words", "")).cast("long")})
    d = d.withColumn("n_symbols", F.regexp_count("text", F.lit(SYMBOLS)).cast("long")).withColumn("n_dup_lines", (F.size("said") - F.size(F.array_distinct("said"))).cast("long"))
    pairs = F.when(F.size(F.array_distinct("runs")) < F.size("runs"), F.sort_array(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("pairs", pairs)
    s = F.col("pairs")
    twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    at = F.col("at")
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(REPEAT_WORDS), F.coalesce(F.get(at, i + 1) - p, F.lit(REPEAT_WORDS)))), F.lit(0), lambda a, x: a + x)
    chars = F.char_length("text").cast("long")
    found = {"c_upper": F.regexp_count("text", F.lit(UPPER)), "c_digit": F.regexp_count("text", F.lit(DIGIT)), "c_point": F.regexp_count("text", F.lit(POINT)), "c_symbol": F.col("n_symbols"), "c_space": chars - F.col("word_chars")}
    size_of = F.size("common")
    bins = [reduce(lambda e, lang: e.when(F.col("lang") == lang, size_of - F.size(F.array_remove("common", LANGUAGES[lang][i])) if i < len(LANGUAGES[lang]) else F.lit(0)), LANGUAGES, F.when(F.lit(False), F.lit(0))) for i in range(len(BINS) - 1)]
    d = d.select("_row", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), chars.alias("chars"), *[x.cast("long").alias(c) for c, x in found.items()], *[F.coalesce(x, F.lit(0)).cast("long").alias(c) for c, x in zip(BINS, bins)], F.coalesce(size_of, F.lit(0)).alias("n_common"))
    return d.withColumn("c_rest", F.col("chars") - sum((F.col(c) for c in CLASSES[1:-1]), F.col(CLASSES[0]))).withColumn("w_rest", F.col("n_words") - F.col("n_common"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (0 to 1) of two histograms, arrays of counts; null if either is empty. p and q must be columns."""
    total = lambda x: F.nullif(F.aggregate(x, F.lit(0).cast("long"), lambda n, c: n + c), F.lit(0))
    shares = F.zip_with(p, q, lambda a, b: F.struct((a / total(p)).alias("x"), (b / total(q)).alias("y")))
    part = lambda v, s: F.when(v > 0, v * F.ln(2 * v / (s["x"] + s["y"]))).otherwise(0.0)
    both = F.aggregate(shares, F.lit(0.0), lambda n, s: n + part(s["x"], s) + part(s["y"], s))
    return F.sqrt(F.greatest(F.lit(0.0), both) / (2 * F.ln(F.lit(2.0))))


def judge(docs: DataFrame, carried: list[str], text_col: str = "text", lang_col: str = "lang", by_length: bool = False) -> DataFrame:
    """_row, the counts, js_chars, js_words, base_failed and kept of every document."""
    c = materialize(counts(docs, carried, text_col, lang_col), "quality")
    names = [*CLASSES, *BINS]
    # at most one row for each of LANGUAGES
    reference = c.where(F.col("lang").isin(*LANGUAGES)).groupBy("lang").agg(*[F.sum(x).alias(f"r_{x}") for x in names])
    d = c.join(F.broadcast(reference), "lang", "left")
    hist = lambda names, prefix="": F.array(*[F.col(prefix + x) for x in names])
    d = d.select("_row", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", hist(CLASSES).alias("p_chars"), hist(CLASSES, "r_").alias("q_chars"), hist(BINS).alias("p_words"), hist(BINS, "r_").alias("q_words"))
    known = F.get("q_chars", 0).isNotNull()
    d = d.withColumn("js_chars", F.when(known & (F.col("chars") >= CHARS_FROM), distance(F.col("p_chars"), F.col("q_chars"))))
    d = d.withColumn("js_words", F.when(known & (F.col("n_words") >= (MIN_WORDS if by_length else WORDS_FROM)), distance(F.col("p_words"), F.col("q_words"))))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    most = F.lit(MAX_WORDS_DISTANCE)
    if by_length:
        root = F.sqrt("n_words")
        judged = d.where(~F.col("base_failed") & F.col("js_words").isNotNull())
        # at most one row for each of LANGUAGES
        quartiles = judged.groupBy("lang").agg(F.percentile_approx(F.col("js_words") * root, [0.5, 0.75]).alias("z"))
        d = d.join(F.broadcast(quartiles), "lang", "left")
        most = F.least(F.when(F.col("n_words") >= WORDS_FROM, most), F.greatest(F.lit(NEAR_WORDS), (F.get("z", 0) + WIDTHS * (F.get("z", 1) - F.get("z", 0))) / root))
    far = F.coalesce(F.col("js_chars") > MAX_CHARS_DISTANCE, F.lit(False)) | F.coalesce(F.col("js_words") > most, F.lit(False))
    return d.select("_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "js_chars", "js_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"))


def filter_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The kept rows of docs, all columns."""
    return judge(docs, docs.columns, text_col, lang_col, by_length=True).where("kept").select("_row.*")
