"""URL filters: domain rules, else naive Bayes over segmented host and path tokens.

Rules fit a host, its subdomains and a path prefix; the longest wins.  Where no rule
fits, the names of the host are split into words (unigram Viterbi for names written
together), and a multinomial naive Bayes model scores these and the words of the path.

The model learns from the pages themselves: urls that a rule decides are its examples,
all but those held out; two lists of words, which together count as much as the examples
do, serve as a prior.  The words that the rules are written in are left out: the rules
decide on them, and learning them would only spread the rules to urls they don't fit.
Its counts are kept as a table of words and joined with the words of distinct urls (host and path words), so
pages are not moved and nothing that grows with the corpus is broadcast unless its
size, which is counted, allows it.  The unigram counts come from all pages' text:
substrings of the distinct host names are joined with them, so each name carries its
own small table of candidate words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_extract import host_of
from .scratch import Scratch

#: (verdict, host, path prefix)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
LONGEST_WORD = 20
#: Larger tables are not broadcast.
BROADCAST_BYTES = 32_000_000
#: A word of the lists counts as so many examples at least; every word of the model as so many of either kind.
SEED_WEIGHT, SMOOTHING = 5, 1.0
#: Urls whose crc32 has this remainder by HOLD are not learned from.
HOLD, HELD_OUT = 5, 0
#: Words known beforehand, of urls to block and to allow; parameters of ``judge``.
BLOCKED_EXAMPLES = (
    "cheap pills cheap viagra discount pharmacy pills online casino casinos bonus casino jackpot slots poker bet bets betting gambling "
    "spam farm spam link farm linkfarm click bait clickbait free money easy cash payday loan loans crypto double profit win prize winner lottery "
    "porn xxx adult sex cams escort nude hot dating singles torrent crack keygen warez malware phishing scam fake replica watches weight loss miracle cure"
)
ALLOWED_EXAMPLES = (
    "blog news www m wiki docs help about article articles story stories post posts science history music art school library university research health sport travel "
    "weather recipe recipes garden book books review reviews guide forum support developer community museum government city local world culture education "
    "en de fr es it html index page"
)
#: Prior share of blocked URLs.
PRIOR_BLOCKED = 0.1


def path_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return rest


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path prefix together, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


# --- words of names ----------------------------------------------------------------------------


def segment(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest split of a name into words (Viterbi); unknown words cost more the longer they are."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            w = name[start:end]
            c = counts.get(w, 0)
            p = math.log(c / total) if c else -math.log(total) - 2.3 * len(w)
            options.append((best[start][0] + p, start))
        best.append(max(options))
    words, end = [], len(name)
    while end:
        start = best[end][1]
        words.append(name[start:end])
        end = start
    return words[::-1]


def names_of(host: str) -> list[str]:
    return re.findall(r"[^\W_]+", host.lower())


def path_tokens(path: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", path.lower())


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) of the letters-only words of all pages' text between tags, lower-cased; at most LONGEST_WORD letters."""
    plain = F.regexp_replace(F.lower(F.coalesce("html", F.lit(""))), r"<[^>]*>|&[a-z0-9#]+;?", " ")
    words = pages.select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("word"))
    return words.where((F.length("word") > 0) & (F.length("word") <= LONGEST_WORD)).groupBy("word").agg(F.count("*").alias("n"))


def _split_names(host: str, known) -> list[tuple[str, bool]]:
    """Names of a host, and whether they are to be segmented: not the last label, nor a known word."""
    names, label = names_of(host), host.rpartition(".")[2]
    last = len(names_of(label)) if "." in host else 0
    return [(n, i < len(names) - last and n not in known) for i, n in enumerate(names)]


def _substrings(known):
    """Candidate words, of two letters at least, of each host's names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts, words = [], []
        for batch in batches:
            for host in batch.column("host").to_pylist():
                found = {n[i:j] for n, cut in _split_names(host, known) if cut for i in range(len(n)) for j in range(i + 2, min(len(n), i + LONGEST_WORD) + 1)}
                hosts += [host] * len(found)
                words += found
                if len(words) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(words, pa.string())], ["host", "word"])
                    hosts, words = [], []
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(words, pa.string())], ["host", "word"])

    return run


def _segments(known, total: int):
    def run(batches):
        for batch in batches:
            hosts, words = [], []
            for host, found in zip(batch.column("host").to_pylist(), batch.column("found").to_pylist()):
                counts = {x["word"]: x["n"] for x in found or [] if x and x["word"] is not None}
                for w in known:
                    counts[w] = counts.get(w, 0) + 50
                hosts.append(host)
                words.append(" ".join(w for n, cut in _split_names(host, known) for w in (segment(n, counts, total) if cut else [n])))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(words, pa.string())], ["host", "words"])

    return run


def segment_hosts(pages: DataFrame, known: frozenset[str]) -> DataFrame:
    """(host, words) for each distinct host of ``pages`` (url, html): its names, in order, as words.

    ``known`` words are words whatever the texts say.  Null urls have the host ''; repeated
    rows are one host; an empty table gives an empty one.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct()
    counts = Scratch(pages.sparkSession).save(word_counts(pages))
    found = hosts.mapInArrow(_substrings(known), "host string, word string").join(counts, "word").groupBy("host").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return hosts.join(found, "host", "left").mapInArrow(_segments(known, total + 50 * len(known)), "host string, words string")


def _fits(table: DataFrame, *columns: str) -> DataFrame:
    """A written table, marked for broadcast if its bytes, which are counted, allow it."""
    size = table.agg(F.sum(reduce(add, [F.octet_length(c) for c in columns], F.lit(64)))).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def word_weights(examples: DataFrame, blocked: Counter, allowed: Counter) -> DataFrame:
    """(token, weight): log of how much likelier each token is in a blocked url than in an allowed one.

    ``examples``: (tokens, nb, na), token lists with their numbers of blocked and allowed urls.
    ``blocked`` and ``allowed`` are prior counts, raised to the number of the examples' tokens.  Tokens of neither are left out: they say nothing.
    """
    spark = examples.sparkSession
    scratch = Scratch(spark)
    seen = scratch.save(examples.where("nb + na > 0").select(F.explode("tokens").alias("token"), "nb", "na").groupBy("token").agg(F.sum("nb").alias("nb"), F.sum("na").alias("na")))
    total = seen.agg(F.sum(F.col("nb") + F.col("na"))).first()[0] or 0
    times = max(SEED_WEIGHT, -(-total // max(1, blocked.total() + allowed.total())))
    prior = spark.createDataFrame([(w, times * blocked[w], times * allowed[w]) for w in sorted({*blocked, *allowed})], "token string, nb long, na long")
    counts = scratch.save(seen.unionByName(prior).groupBy("token").agg(F.sum("nb").alias("nb"), F.sum("na").alias("na")))
    b, a, v = counts.agg(F.sum("nb"), F.sum("na"), F.count("*")).first()
    of = lambda c, total: F.log((F.col(c) + SMOOTHING) / float((total or 0) + SMOOTHING * max(v, 1)))
    return counts.select("token", (of("nb", b) - of("na", a)).alias("weight"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, blocked: str = BLOCKED_EXAMPLES, allowed: str = ALLOWED_EXAMPLES, prior: float = PRIOR_BLOCKED) -> DataFrame:
    """(page_id, host, path, rule, verdict, words, score): one row for each row of ``pages``.

    Null urls and urls without ``://`` have an empty host and path, fit no rule and are
    judged by the prior.  ``score`` is the log odds of blocked by the method, also where
    a rule decides.  Further columns are ignored, repeated rows stay, an empty table
    gives an empty one.
    """
    scratch = Scratch(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), (F.crc32(F.coalesce("url", F.lit(""))) % HOLD != HELD_OUT).alias("learn"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    path_words = F.array_join(F.regexp_extract_all(F.lower("path"), F.lit(r"[\p{L}]+"), F.lit(0)), " ")
    rows = rows.withColumns({"rule": rule, "by_rule": verdict, "path_words": path_words})
    own = {w for _, h, p in rules for w in (*path_tokens(h), *path_tokens(p))}
    seeds = tuple(Counter(w for w in path_tokens(words) if w not in own) for words in (blocked, allowed))
    hosts = segment_hosts(pages, frozenset({*seeds[0], *seeds[1]}))
    times = lambda v: F.count_if(F.col("learn") & F.coalesce(F.col("by_rule") == v, F.lit(False)))
    kinds = rows.groupBy("host", "path_words").agg(times("block").alias("nb"), times("allow").alias("na"))
    tokens = F.filter(F.split(F.concat_ws(" ", "words", "path_words"), " "), lambda w: (w != "") & ~w.isin(sorted(own)))
    kinds = scratch.save(kinds.join(hosts, "host").withColumn("tokens", tokens))
    weights = scratch.save(word_weights(kinds, *seeds))
    sums = kinds.select("host", "path_words", F.explode("tokens").alias("token")).join(_fits(weights, "token"), "token").groupBy("host", "path_words").agg(F.sum("weight").alias("sum"))
    score = F.coalesce("sum", F.lit(0.0)) + math.log(prior / (1 - prior))
    scored = scratch.save(kinds.join(sums, ["host", "path_words"], "left").select("host", "path_words", "words", score.alias("score")))
    out = rows.join(_fits(scored, "host", "path_words", "words"), ["host", "path_words"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "words", "score")
