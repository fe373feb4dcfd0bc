"""Personal data: patterns for protected entities, and information-theoretic sanitisation of what reveals them.

The patterns find e-mail and IP addresses, card and phone numbers. A term (a word with a letter, of any length, A-Z
lower-cased) that stands within `reach` characters of a mention is judged by the corpus, against the entity's exact
value and against its kind: with IC(e) = log2(words / mentions of e) and PMI(t; e) = log2(p(e | t) / p(e)), where
p(e | t) is the share of all occurrences of t that stand by e, its disclosure of e is PMI / IC, close to 1 if t hardly
occurs elsewhere. One more occurrence elsewhere is added to every term, so that few occurrences prove less than many.
The evidence must be significant: the likelihood ratio of the count by e, against what the share of all words by e
would give, is at least `sure` (15: about one chance in 10,000), and the term was met in at least `support` different
contexts. Terms disclosing an entity to `generalise` or more are replaced by [TERM] wherever they occur, and are
removed from `remove` on. Counts cover all rows, copies included; contexts are told apart by their text, so copies of
one context don't count as evidence. Words that `reach` cuts are left out; so are terms inside of an entity.

DataFrame functions only. Spans count code points from 0, ends exclusive. Null texts count as empty. Rows equal in doc_id and
text get the same spans. Empty tables give empty results. Input columns named as the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read, without, written

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns; possessive and anchored where that finds the same spans without trying again.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
#: Characters of words; a word has one that is no digit.
IN_WORD, LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
TERM = rf"(?<![0-9])[0-9]*+{LETTER}{IN_WORD}*+"
REACH, SUPPORT, SURE, GENERALISE, REMOVE = 80, 2, 15.0, 0.95, 0.99
#: Terms that are broadcast to the words of the corpus; more of them are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: Rows with spans that are broadcast to all rows; more of them are joined by a shuffle.
BROADCAST_HOLDERS = 20_000
BASE_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
TERM_SPANS = BASE_SPANS.replace("string>>", "string,removed:boolean>>")
ADDED = ("base_spans", "term_spans", "sanitised")


def valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(IP_PARTS)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def matches(text: Column, pattern: Column, kind: str) -> Column:
    """Array of (start, rank, end, kind, value) of the valid matches: leftmost, not overlapping.

    What lies between the matches and the matches themselves alternate, so lengths add up to positions.
    """
    rank = KINDS.index(kind) if kind in KINDS else len(KINDS)
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    empty = F.array().cast(BASE_SPANS)
    step = lambda acc, x: F.struct(
        (acc["at"] + F.char_length(x["gap"]) + F.coalesce(F.char_length(x["value"]), F.lit(0))).alias("at"),
        F.when(x["value"].isNull() | ~valid(kind, x["value"]), acc["spans"]).otherwise(F.array_append(acc["spans"], F.struct(
            (acc["at"] + F.char_length(x["gap"])).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + F.char_length(x["gap"]) + F.char_length(x["value"])).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))).alias("spans"),
    )
    steps = F.arrays_zip(between.alias("gap"), found.alias("value"))
    return F.when(F.size(found) == 0, empty).otherwise(F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)["spans"])


def base_spans(text: Column) -> Column:
    return F.sort_array(F.concat(*[matches(text, F.lit(PATTERNS[kind]), kind) for kind in KINDS]))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


def sized(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has few rows; df must be a written table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def contexts(holders: DataFrame, reach: int) -> DataFrame:
    """entity (a kind, or a kind and value), context hash and distinct terms of every mention; holders has text and base_spans."""
    at = holders.select("text", F.explode("base_spans").alias("s"))
    left = F.substring(F.col("text"), F.greatest(F.col("s.start") - reach + 1, F.lit(1)), F.least(F.col("s.start"), F.lit(reach)))
    right = F.substring(F.col("text"), F.col("s.end") + 1, F.lit(reach))
    left = F.when(F.col("s.start") > reach, F.regexp_replace(left, f"^{IN_WORD}+", "")).otherwise(left)
    right = F.when(F.char_length("text") > F.col("s.end") + reach, F.regexp_replace(right, f"{IN_WORD}+$", "")).otherwise(right)
    around = at.select("s.kind", F.concat_ws(":", "s.kind", "s.value").alias("value"), F.concat_ws("\n", left, right).alias("around"))
    around = around.select("kind", "value", F.xxhash64("around").alias("context"), F.array_distinct(terms_of(F.col("around"))).alias("terms"))
    return around.select(F.explode(F.array("kind", "value")).alias("entity"), "context", "terms")


def likelihood_ratio(both: Column, occurrences: Column, share: Column) -> Column:
    """Twice the log likelihood ratio of `both` of the occurrences against a chance of `share`; 0 where there are fewer than expected."""
    n, k = F.greatest(occurrences, both).cast("double"), both.cast("double")
    rest = F.when(n > k, (n - k) * F.log((n - k) / (n * (1 - share)))).otherwise(F.lit(0.0))
    return F.when(k > n * share, 2 * (k * F.log(k / (n * share)) + rest)).otherwise(F.lit(0.0))


def judged_terms(docs: DataFrame, holders: DataFrame, reach=REACH, support=SUPPORT) -> DataFrame:
    """term, entity, both, contexts, occurrences, ratio and disclosure of the terms met in enough contexts."""
    around = written(contexts(holders, reach))
    met = around.select("entity", "context", F.explode("terms").alias("term"))
    by_context = met.groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    together = written(by_context.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count("*").alias("contexts")).where(F.col("contexts") >= support))
    mentions = around.groupBy("entity").agg(F.count("*").alias("mentions"), F.sum(F.size("terms")).alias("near"))
    candidates = written(together.select("term").distinct())
    # counted first: a join before would meet every occurrence of a word; all other words end up in the row without a term
    counted = docs.select(F.explode(terms_of(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counted = counted.join(sized(candidates, BROADCAST_TERMS), F.col("word") == F.col("term"), "left")
    counts = written(counted.groupBy("term").agg(F.sum("n").alias("occurrences")))
    total = float(counts.agg(F.sum("occurrences")).first()[0] or 0)
    information = F.log2(F.lit(total) / F.col("mentions"))
    share = F.least(F.col("both") / (F.col("occurrences") + 1), F.lit(1.0))
    joined = together.join(counts, "term").join(mentions, "entity").where(information > 0)
    ratio = likelihood_ratio(F.col("both"), F.col("occurrences"), F.least(F.col("near") / F.lit(max(total, 1.0)), F.lit(0.999999)))
    return joined.select("term", "entity", "both", "contexts", "occurrences", ratio.alias("ratio"), (1 + F.log2(share) / information).alias("disclosure"))


def disclosing_terms(docs: DataFrame, holders: DataFrame, reach=REACH, support=SUPPORT, sure=SURE, generalise=GENERALISE) -> DataFrame:
    """term and disclosure, the highest over entities, of the terms to sanitise."""
    judged = judged_terms(docs, holders, reach, support).where((F.col("ratio") >= sure) & (F.col("disclosure") >= generalise))
    return judged.groupBy("term").agg(F.max("disclosure").alias("disclosure"))


def term_spans(found: DataFrame, terms: DataFrame, remove=REMOVE) -> DataFrame:
    """doc_id, text hash and spans of the rows that hold a term to sanitise; found has doc_id, text_hash and text."""
    key = ["doc_id", "text_hash"]
    hits = found.select(*key, F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).join(sized(terms, BROADCAST_TERMS), "term").distinct()
    holders = hits.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("term", "disclosure"))).alias("terms"))
    texts = holders.join(found.select(*key, "text").withColumnsRenamed({"doc_id": "d", "text_hash": "h"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).dropDuplicates(key)
    one = texts.select(*key, "text", F.explode("terms").alias("t"))
    pattern = F.concat(F.lit(f"(?<!{IN_WORD})\\Q"), F.col("t.term"), F.lit(f"\\E(?!{IN_WORD})"))
    placed = one.select(*key, F.explode(matches(ascii_lower(F.col("text")), pattern, "term")).alias("s"), (F.col("t.disclosure") >= remove).alias("removed"))
    return placed.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("s.start", "s.rank", "s.end", "s.kind", "s.value", "removed"))).alias("term_spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind, or left out; an overlapping span only extends the one before."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    token = lambda x: F.when(x["removed"], F.lit("")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
    step = lambda acc, x: F.struct(
        F.greatest(acc["at"], x["end"]).alias("at"),
        F.when(x["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), token(x))).alias("out"),
    )
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))


def sanitise(docs: DataFrame, reach=REACH, support=SUPPORT, sure=SURE, generalise=GENERALISE, remove=REMOVE) -> DataFrame:
    """docs with base_spans, term_spans and sanitised, the text without what the spans cover."""
    docs = without(docs, *ADDED, "text_hash")
    whole = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", whole.alias("text"), F.xxhash64(whole).alias("text_hash"))
    key, keyed = ["doc_id", "text_hash"], {"doc_id": "d", "text_hash": "h"}
    holders = written(texts.withColumn("base_spans", base_spans(F.col("text"))).where(F.size("base_spans") > 0))
    terms = written(disclosing_terms(texts, holders, reach, support, sure, generalise))
    spans = holders.select(*key, "base_spans").dropDuplicates(key)
    if terms.limit(1).count():
        placed = term_spans(texts, terms, remove).withColumnsRenamed(keyed)
        spans = spans.join(placed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "full")
        spans = spans.select(F.coalesce("doc_id", "d").alias("d"), F.coalesce("text_hash", "h").alias("h"), "base_spans", "term_spans")
    else:
        spans = spans.withColumnsRenamed(keyed).withColumn("term_spans", F.array().cast(TERM_SPANS))
    spans = sized(written(spans), BROADCAST_HOLDERS)
    joined = docs.withColumn("text_hash", F.xxhash64(whole)).join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").drop("d", "h", "text_hash")
    joined = joined.withColumn("base_spans", F.coalesce("base_spans", F.array().cast(BASE_SPANS))).withColumn("term_spans", F.coalesce("term_spans", F.array().cast(TERM_SPANS)))
    inside = lambda x: F.exists("base_spans", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    joined = joined.withColumn("term_spans", F.filter("term_spans", lambda x: ~inside(x)))
    marked = F.transform("base_spans", lambda x: F.struct(x["start"], x["rank"], x["end"], x["kind"], x["value"], F.lit(False).alias("removed")))
    return joined.withColumn("sanitised", sanitised(whole, F.sort_array(F.concat(marked, F.col("term_spans")))))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sanitise(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    plain = F.transform("term_spans", lambda x: F.struct(x["start"], x["rank"], x["end"], x["kind"], x["value"]))
    spans = F.sort_array(F.concat(F.col("base_spans"), plain))
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(digest(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), digest(spans).alias("spans"), F.size("term_spans").cast("long").alias("n_term"))
