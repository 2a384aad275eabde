"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a set of terms (its words, A-Z lower-cased) weighted by their counts. Sample k of a text draws, from a hash of each
term and k, r and c ~ Gamma(2, 1) and b ~ U(0, 1); with t = floor(ln(weight) / r + b) the sample is the pair (term, t) whose
ln a = ln c - r * (t - b + 1) is least. Two texts agree in a sample with the probability of their generalised Jaccard
similarity, sum of least weights over sum of greatest. Of the hash's bits r has 16 and b 8, as they only scale; c, whose
least values decide, has 40.

The least value and its pair are packed into one long, so a sample is a plain minimum and aggregates in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.labelled import chance

SAMPLES = 32
#: Text bytes that a bucket of neighbouring documents aims at, at least; it grows with the root of the table (320 MB at 100 TB),
#: and so does the number of buckets. Rows per bucket that are sampled to find its bounds.
BUCKET_BYTES, ROOT_BYTES, SAMPLED = 4 << 20, 32, 20
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """Hashes of the words of a text, repeats kept; a text without words is a term itself."""
    words = F.array_remove(F.split(F.translate(text, UPPER, LOWER), DELIMITERS), "")
    return F.when(F.size(words) == 0, F.array(text)).otherwise(words)


def sample(term: str, log_weight: str, k: int) -> Column:
    """The term's candidate for sample k: 31 bits of ln a, then 32 bits that name (term, t); t stays below 2^28."""
    z = f"xxhash64({term}, {k})"
    unit = lambda shift, bits: f"(((shiftrightunsigned({z}, {shift}) & {(1 << bits) - 1}L) + 0.5D) / {1 << bits}D)"
    r, b = f"(-ln({unit(56, 8)} * {unit(48, 8)}))", unit(40, 8)
    t = f"floor({log_weight} / {r} + {b})"
    a = f"ln(-ln({unit(20, 20)} * {unit(0, 20)})) - {r} * ({t} - {b} + 1D)"
    return F.expr(f"shiftleft(cast(({a} + 100D) * 16777216D as bigint), 32) | (({term} & 4294967295L) + {t} * 2654435761L & 4294967295L)")


def signatures(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s0, s1, ...) from rows (keys, term, n)."""
    rows = weighted.withColumn("w", F.log(F.col("n").cast("double")))
    return rows.groupBy(*keys).agg(*(F.min(sample("term", "w", k)).alias(f"s{k}") for k in range(SAMPLES)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every document.

    The next document is that with the next smaller doc_id, after the last one the first. The edited text has the last
    floor(n_chars / 2) code points replaced by as many from the start of the next document, or all it has. A fingerprint
    is SAMPLES numbers of 8 hex digits; a likeness is the share of equal ones. Null texts count as empty; texts without
    words are alike only where they are equal. Rows of one doc_id follow each other by a hash of their texts, equal rows stay apart.
    A lone document is its own next one; an empty table gives no rows; other columns are ignored.

    Documents are dealt to buckets of neighbouring ids, and each bucket gets a copy of the document that follows it; from
    then on every step finds its rows in place, so texts are shuffled once. Rows without a doc_id follow all others. Only
    equal rows, which have equal neighbours, can't be dealt to different buckets.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("mark")))
    cuts = bounds(rows)
    # the number of bounds below the key, by halving
    ids, marks = (f"cast(split('{','.join(str(c[j]) for c in cuts)}', ',') as array<bigint>)" for j in (0, 1))
    below = f"({ids}[(x.a + x.b) div 2] < key.id or ({ids}[(x.a + x.b) div 2] = key.id and {marks}[(x.a + x.b) div 2] < key.mark))"
    found = f"aggregate(sequence(1, {max(len(cuts), 1).bit_length()}), named_struct('a', 0, 'b', {len(cuts)}), (x, i) -> if(x.a >= x.b, x, if({below}, named_struct('a', cast((x.a + x.b) div 2 + 1 as int), 'b', x.b), named_struct('a', x.a, 'b', cast((x.a + x.b) div 2 as int)))), x -> x.a)"
    rows = rows.withColumn("bucket", F.expr(found) if cuts else F.lit(0))

    # the first document of each bucket stands once more behind the bucket above it: a row for each bucket
    firsts = rows.groupBy("bucket").agg(F.max("key").alias("key")).orderBy("bucket").collect()
    follow = [(firsts[i].bucket, firsts[i - 1].key) for i in range(len(firsts))]
    if follow:
        after = spark.createDataFrame(follow, "bucket int, key struct<id:bigint,mark:bigint>")
        texts = rows.select("doc_id", "key", "text").join(F.broadcast(after), "key").groupBy("bucket", "doc_id", "key").agg(F.max("text").alias("text"))
        rows = rows.select(F.lit(0).alias("extra"), "bucket", "doc_id", "key", "text").unionByName(texts.select(F.lit(1).alias("extra"), "bucket", "doc_id", "key", "text"))
    else:
        rows = rows.select(F.lit(0).alias("extra"), "bucket", "doc_id", "key", "text")
    # the id decides nothing; with it both users of the buckets ask for the same columns and share one shuffle
    order = Window.partitionBy("bucket").orderBy("extra", F.desc("key"), F.desc("text"), "doc_id")
    near = (
        rows.withColumn("at", F.row_number().over(order))
        .withColumn("next", F.lead("text").over(order))
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
        .withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - half)"), F.expr("substring(coalesce(next, ''), 1, half)")))
    )
    about = near.select("bucket", "at", "extra", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    words = (
        near.select("bucket", "at", F.explode(F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("body")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("body")))).alias("x"))
        .select("bucket", "at", "x.version", F.explode(terms(F.col("x.body"))).alias("word"))
        .select("bucket", "at", "version", F.xxhash64("word").alias("term"))
    )
    keys = ["bucket", "at", "version"]
    drawn = signatures(words.groupBy(*keys, "term").agg(F.count("*").alias("n")), keys)
    print_of = drawn.select(*keys, F.concat(*(F.lpad(F.hex(F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for k in range(SAMPLES))).alias("print"))
    both = print_of.groupBy("bucket", "at").agg(F.max(F.expr("if(version = 0, print, null)")).alias("fingerprint"), F.max(F.expr("if(version = 1, print, null)")).alias("edited_fingerprint"))
    follows = Window.partitionBy("bucket").orderBy("at")
    out = about.join(both, ["bucket", "at"]).withColumn("next", F.lead("fingerprint").over(follows)).where("extra = 0")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next").alias("near_next"))


def bounds(rows: DataFrame) -> list[tuple[int, int]]:
    """Keys that cut the rows into buckets of about equal bytes, from a sample of SAMPLED rows a bucket; they only balance."""
    stats = rows.agg(F.sum(F.octet_length("text") + 64).alias("size"), F.count("*").alias("n")).first()
    size, n = stats.size or 0, stats.n
    wanted = int(size // max(BUCKET_BYTES, ROOT_BYTES * int(size**0.5)))
    if wanted < 2:
        return []
    part = min(1.0, SAMPLED * wanted / n)
    some = rows.where(chance("key.id", "key.mark") < part) if part < 1 else rows
    sampled = sorted((r.id, r.mark, r.bytes) for r in some.select("key.id", "key.mark", (F.octet_length("text") + 64).alias("bytes")).groupBy("id", "mark").agg(F.sum("bytes").alias("bytes")).collect())
    total, seen, out = sum(b for _, _, b in sampled), 0, []
    for i, mark, b in sampled:
        seen += b
        if seen * wanted >= total * (len(out) + 1) and len(out) < wanted - 1:
            out.append((i, mark))
    return out


def likeness(a: str, b: str) -> Column:
    """Share of equal samples of two fingerprints."""
    return sum((F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8)).cast("int") for k in range(SAMPLES)) / F.lit(float(SAMPLES))
