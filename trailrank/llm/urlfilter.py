"""URL verdicts: allow and block rules, else host word segmentation and naive Bayes.

Hosts and paths are split at everything but letters and digits; a host's runs of
letters are split into words by Viterbi over a unigram model, whose counts are
those of the delimited words in all urls plus a seed lexicon. Urls whose words hold a
block seed, or no seed at all, teach a multinomial naive Bayes model over the
segmented tokens; it scores every url that no rule decides.

Counts, totals and odds are tables over all tokens, met by equi-joins, and each
distinct run is segmented once with the counts of its own substrings. Nothing is
broadcast or capped, so it works alike at every size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailrank.llm._store import cut

#: (verdict, rule): host and path of each rule. Fixed by the contract.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Words that mark a url as unwanted; they seed the training labels.
BLOCK_SEEDS = ("spam", "casino", "pills", "bets", "betting", "adult", "porn", "xxx", "sex", "viagra", "ads", "track", "tracker", "malware", "phishing", "poker", "gambling", "loan", "replica", "warez", "torrent", "escort")
#: Words that the unigram model knows from the start, each with this share of all counted words.
LEXICON = (*BLOCK_SEEDS, "farm", "win", "cheap", "free", "online", "shop", "store", "news", "blog", "mail", "home", "world", "tech", "data", "web", "site", "page", "book", "game", "games", "play", "best", "buy", "sale", "deal", "deals", "bank", "health", "travel", "music", "video", "photo", "food", "school", "science", "city", "market", "media", "cloud", "code", "wiki", "forum")
LEXICON_SHARE = 5e-4
MAX_WORD = 24
_PARTS = r"([a-z]+|[0-9]+|[^\x00-\x7f]+)"


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, begins = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + begins)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def raw_tokens(part: Column) -> Column:
    """Runs of letters or of digits or of other letters than ASCII; numbers become ``#`` and their length."""
    runs = F.regexp_extract_all(F.lower(part), F.lit(_PARTS), F.lit(1))
    return F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit("#"), F.length(x))).otherwise(x))


def delimited(host: Column) -> Column:
    """Tokens of a host that are words by themselves: parts of hyphenated labels, and labels of up to four characters."""
    plain = F.filter(F.split(host, r"\."), lambda x: x.contains("-") | (F.length(x) <= 4))
    return raw_tokens(F.array_join(plain, "."))


def unigrams(hosts: DataFrame, paths: DataFrame) -> DataFrame:
    """(word, n): delimited words of all (host, n) and (path, n), and the lexicon's.

    Host labels without a hyphen are what is to be segmented, so they are not counted as words.
    """
    said = hosts.select(F.explode(delimited(F.col("host"))).alias("word"), "n").unionByName(paths.select(F.explode(raw_tokens(F.col("path"))).alias("word"), "n"))
    counted = said.where("word NOT LIKE '#%'").groupBy("word").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    known = total.select(F.explode(F.array(*[F.lit(w) for w in LEXICON])).alias("word"), F.greatest(F.lit(1), F.floor(F.coalesce("total", F.lit(0)) * LEXICON_SHARE)).cast("long").alias("n"))
    return counted.unionByName(known).groupBy("word").agg(F.sum("n").alias("n"))


def segment(run: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest split of a run of letters; unknown words cost more with each letter."""
    unknown = math.log(total + 1) + 2
    best, back = [0.0], [0]
    for end in range(1, len(run) + 1):
        words = ((s, run[s:end]) for s in range(max(0, end - MAX_WORD), end))
        cost, start = min((best[s] + (math.log((total + 1) / counts[w]) if w in counts else unknown + 2.5 * len(w)), s) for s, w in words)
        best.append(cost)
        back.append(start)
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


def _segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch["run"].to_pylist(), batch["known"].to_pylist(), batch["total"].to_pylist(), strict=True)
        split = [segment(run, {k["word"]: k["n"] for k in known or []}, total) for run, known, total in rows]
        yield pa.RecordBatch.from_arrays([batch["run"], pa.array(split, pa.list_(pa.string()))], ["run", "words"])


def segmented(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run, words) for distinct runs of letters, under the unigram counts (word, n)."""
    length = F.length("run")
    starts = runs.select("run", F.explode(F.sequence(F.lit(1), length)).alias("s"))
    parts = starts.select("run", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), length - F.col("s") + 1)), lambda n: F.substring(F.col("run"), F.col("s"), n))).alias("word")).distinct()
    known = parts.join(words.hint("merge"), "word").groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    total = F.broadcast(words.agg(F.sum("n").alias("total")))  # one row
    return runs.join(known.hint("merge"), "run", "left").crossJoin(total).select("run", "known", "total").mapInArrow(_segment, "run string, words array<string>")


def host_tokens(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, token): ``h:`` and the words of each host, repeats included."""
    runs = hosts.select("host", F.explode(raw_tokens(F.col("host"))).alias("run"))
    letters = runs.where("run RLIKE '^[a-z]'")
    split = segmented(letters.select("run").distinct(), words)
    found = letters.join(split.hint("merge"), "run").select("host", F.explode("words").alias("word"))
    found = found.unionByName(runs.where("NOT run RLIKE '^[a-z]'").withColumnRenamed("run", "word"))
    return found.select("host", F.concat(F.lit("h:"), "word").alias("token"))


def path_tokens(path: Column) -> Column:
    return F.transform(raw_tokens(path), lambda w: F.concat(F.lit("p:"), w))


def token_odds(tally: DataFrame) -> DataFrame:
    """(token, odds, unknown) from (token, block, allow): log odds with add-one smoothing, also those of a token never seen."""
    totals = F.broadcast(tally.agg(F.sum("block").alias("b"), F.sum("allow").alias("a"), (F.count(F.lit(1)) + 1).alias("size")))  # one row
    odds = F.log((F.col("block") + 1) / (F.col("b") + F.col("size"))) - F.log((F.col("allow") + 1) / (F.col("a") + F.col("size")))
    return tally.crossJoin(totals).select("token", odds.alias("odds"), F.log((F.col("a") + F.col("size")) / (F.col("b") + F.col("size"))).alias("unknown"))


def judge(pages: DataFrame, rules=RULES, teaches: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, seeded) for every row.

    Without a rule the verdict is block where the score, naive Bayes' log odds,
    is positive. ``seeded`` is whether a word of the url is a block seed, which is
    what the model learns from; ``teaches``, a condition on host and path, limits
    the rows that it learns from (all, if None). A null url, or one without
    ``://``, has an empty host and path and is judged like others (by the prior:
    allow, unless most urls are blocked). Repeated rows and null ids give rows;
    extra columns are ignored; an empty table gives no rows.
    """
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = cut(parts.withColumn("row", F.monotonically_increasing_id()), "urls")
    hosts = cut(parts.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    paths = parts.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    of_host = cut(host_tokens(hosts, cut(unigrams(hosts, paths), "unigrams")), "host-tokens")

    seeds = F.substring("token", 3, 1 << 20).isin(*BLOCK_SEEDS)
    bad_hosts = of_host.groupBy("host").agg(F.max(seeds).alias("bad"))
    bad_path = F.exists(path_tokens(F.col("path")), lambda t: F.substring(t, 3, 1 << 20).isin(*BLOCK_SEEDS))
    marked = parts.join(bad_hosts.hint("merge"), "host", "left").withColumn("seeded", F.coalesce("bad", F.lit(False)) | bad_path).drop("bad")
    marked = cut(marked.withColumn("teaches", F.lit(True) if teaches is None else F.coalesce(teaches, F.lit(False))), "marked-urls")
    taught = marked.where("teaches")
    block, allow = F.sum(F.col("seeded").cast("long")).alias("block"), F.sum((~F.col("seeded")).cast("long")).alias("allow")
    by_host = of_host.join(taught.groupBy("host").agg(block, allow).hint("merge"), "host").select("token", "block", "allow")
    by_path = taught.select(F.explode(path_tokens(F.col("path"))).alias("token"), F.col("seeded").cast("long").alias("block"), (~F.col("seeded")).cast("long").alias("allow"))
    tally = by_host.unionByName(by_path).groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    odds = cut(token_odds(tally), "token-odds")
    never = F.broadcast(odds.agg(F.coalesce(F.max("unknown"), F.lit(0.0)).alias("never")))  # one row
    prior = F.broadcast(taught.agg(F.log((F.coalesce(F.sum(F.col("seeded").cast("long")), F.lit(0)) + 1) / (F.coalesce(F.sum((~F.col("seeded")).cast("long")), F.lit(0)) + 1)).alias("prior")))

    met = lambda df: df.join(odds.select("token", "odds").hint("merge"), "token", "left").crossJoin(never).withColumn("odds", F.coalesce("odds", "never"))
    host_score = met(of_host).groupBy("host").agg(F.sum("odds").alias("host_score"))
    path_score = met(marked.select("row", F.explode(path_tokens(F.col("path"))).alias("token"))).groupBy("row").agg(F.sum("odds").alias("path_score"))
    scored = marked.join(host_score.hint("merge"), "host", "left").join(path_score.hint("merge"), "row", "left").crossJoin(prior)
    score = F.round(F.col("prior") + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0)), 9).alias("score")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"), score, "seeded")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score", "seeded")


def match_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) by the rules alone; rule and verdict are null where none fits."""
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
