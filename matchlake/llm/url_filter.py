"""URL filters: prefix rules first, then a weighted vocabulary found by one Aho-Corasick pass.

A rule (host, path, verdict) fits its host and all subdomains if the url's path starts
with the rule's; the longest rule wins. Without a rule the vocabulary decides: every
term has a weight, a strict one the LIMIT, a soft one less. A url whose distinct terms
weigh LIMIT or more together is blocked, so by one strict term or several soft ones. A
term counts only with no letter or digit before and behind it.

The vocabulary is an input: pairs of term and weight, by default TERMS (a short list in
four languages), or a table by `vocabulary`.

Nulls and ties: a null url or one without :// has an empty host and path, fits no rule
and is judged by its whole text; rows that repeat are judged alike; of equally long
rules the first in order of host and path wins; long urls are searched whole; an empty
table gives no rows; other columns pass in _row and can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm._common import packed

#: The rules.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: The weight that blocks.
LIMIT = 10
#: Terms by weight. Strict ones say alone what a page is for; a word that encyclopedias, papers or shops use as well is soft, whatever
#: its subject, and everyday words weigh so little that they only tip a url that two soft terms have brought near the limit.
TERMS_BY_WEIGHT = {
    LIMIT: (
        "camgirl", "camgirls", "cialis", "erotikkontakte", "hentai", "keygen", "nudes", "porn", "porno", "putas", "putes", "salope", "viagra", "warez", "xxx",
        "casino-bonus", "casino-en-ligne", "casino-online", "free-bets", "free-spins", "online-casino", "online-kasino", "paris-sportifs", "payday-loans", "replica-watches", "sportwetten-bonus",
    ),
    5: (
        "apuestas", "betting", "botnet", "casino", "crack", "desnuda", "desnudas", "escort", "escorts", "huren", "jackpot", "keylogger", "lottery", "malware", "nackt", "nude",
        "partnersuche", "phishing", "pilules", "poker", "sex", "sexe", "sexo", "slots", "sofortkredit", "torrent", "wetten",
    ),
    4: ("bet", "bets", "citas", "dating", "kredit", "loan", "loans", "loteria", "loterie", "lotto", "pari", "pastillas", "pillen", "pills", "prestamo", "prestamos", "rencontres", "replica"),
    2: ("adult", "barato", "billig", "cheap", "cher", "free", "gagner", "gana", "gewinn", "girls", "gratis", "gratuit", "win"),
}
TERMS = tuple(sorted((term, weight) for weight, terms in TERMS_BY_WEIGHT.items() for term in terms))


def vocabulary(terms: DataFrame, most: int = 1_000_000) -> tuple[tuple[str, int], ...]:
    """Terms of a table (term, weight), lower-cased; of one term's weights the greatest. A table of over `most` rows is an error."""
    lower = terms.where("term is not null and term <> '' and weight is not null").groupBy(F.lower("term").alias("term")).agg(F.max("weight").cast("int").alias("weight"))
    rows = lower.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary of over {most} terms")
    return tuple(sorted((r.term, r.weight) for r in rows))


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased."""
    found = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict."""
    fits = [(F.when((F.lit(x) == h) | F.endswith(h, F.lit(f".{x}")), F.startswith(p, F.lit(y))).otherwise(False), x + y, v) for x, y, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))]
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for ok, text, v in reversed(fits):
        name, verdict = F.when(ok, F.lit(text)).otherwise(name), F.when(ok, F.lit(v)).otherwise(verdict)
    return name, verdict


def _counter(terms: tuple[tuple[str, int], ...], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for term, weight in terms:
            machine.add_word(term, (term, weight))
        machine.make_automaton()
        for b in batches:
            counts = []
            for url in b.column("_url").to_pylist():
                text, hits = (url or "").lower(), {}
                for end, (term, weight) in machine.iter(text) if terms else ():
                    begin = end - len(term)
                    if not (begin >= 0 and text[begin].isalnum()) and not (end + 1 < len(text) and text[end + 1].isalnum()):
                        hits[term] = weight
                strict = sum(w >= limit for w in hits.values())
                counts.append((strict, len(hits) - strict, sum(hits.values())))
            cols = [pa.array([c[i] for c in counts], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("_row"), *cols], ["_row", "n_strict", "n_soft", "weight"])

    return run


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, terms: tuple[tuple[str, int], ...] = TERMS, limit: int = LIMIT) -> DataFrame:
    """_row (a struct of all columns), host, path, rule, n_strict, n_soft, weight and verdict (allow or block) of every row."""
    rows = packed(pages, url_col).withColumnRenamed(f"_{url_col}", "_url")
    counted = f"_row {rows.schema['_row'].dataType.simpleString()}, n_strict int, n_soft int, weight int"
    found = rows.mapInArrow(_counter(tuple(terms), limit), counted)
    parts = found.withColumn("host", host(F.col("_row")[url_col])).withColumn("path", path(F.col("_row")[url_col]))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("weight") >= limit, F.lit("block")).otherwise(F.lit("allow"))
    return parts.select("_row", "host", "path", name.alias("rule"), "n_strict", "n_soft", "weight", F.coalesce(verdict, own).alias("verdict"))
