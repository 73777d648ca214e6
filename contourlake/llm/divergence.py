"""How far a language's sources diverge, by exact shares of their terms.

A first scan builds partial count-min sketches of document frequencies, which ranges of the hash merge;
they never underestimate, so the second scan drops the terms that can't reach the least frequency
before anything is shuffled. What is left is counted exactly. Pairs of sources are then joined on the
terms that both have; for all other terms a difference depends on one source's count alone, and is
summed over each source's histogram of counts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ranges
from .kernels import LOWER, Words, mix, slices, text_buffer, words
from .store import table, written

#: Bytes that part terms: all of ASCII but letters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[0x41:0x5B] = NO_LETTER[0x61:0x7B] = NO_LETTER[0x80:] = False
#: Text of one segment.
SEGMENT_BYTES = 8 << 20
#: Shares are counted in billionths.
SCALE = 1_000_000_000

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])
COUNTS_DDL = "lang string, source string, term string, docs long, n long"


def hashes_of(terms: pa.Array) -> np.ndarray:
    data, at = text_buffer(terms)
    return Words(data, at[:-1], at[1:], np.array([0, len(terms)])).hashes() if len(terms) else np.zeros(0, np.uint64)


class Segment:
    """The terms of a part of a scan: for each document and term how often; terms, languages and sources by number."""

    def __init__(self, batch: pa.RecordBatch):
        data, at = text_buffer(batch.column(0))
        data = LOWER[data]
        found = words(data, at, NO_LETTER)
        bounds = np.concatenate(([0], np.cumsum(found.end - found.start))).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_string(), len(found.start), [None, pa.py_buffer(bounds), pa.py_buffer(data[~NO_LETTER[data]])]).dictionary_encode()
        self.terms = coded.dictionary
        self.langs, self.sources = (batch.column(k).dictionary_encode() for k in (1, 2))
        pairs, self.n = np.unique(found.owner() * max(1, len(self.terms)) + coded.indices.to_numpy(), return_counts=True)
        self.doc, self.term = np.divmod(pairs, max(1, len(self.terms)))
        self.lang = self.langs.indices.to_numpy()[self.doc]
        self.source = self.sources.indices.to_numpy()[self.doc]

    def keys(self) -> np.ndarray:
        """For each document and term a hash of (language, term)."""
        if not len(self.doc):
            return np.zeros(0, np.uint64)
        return mix(hashes_of(self.terms)[self.term] ^ mix(hashes_of(self.langs.dictionary) + np.uint64(1))[self.lang])

    def counts(self, keep: np.ndarray) -> pa.RecordBatch:
        """Documents and occurrences of each kept (language, source, term)."""
        lang, source, term, n = (x[keep] for x in (self.lang, self.source, self.term, self.n))
        group = (lang.astype(np.int64) * len(self.sources.dictionary) + source) * max(1, len(self.terms)) + term
        own, at, back, docs = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
        total = np.bincount(back, n, len(own)).astype(np.int64)  # exact: a segment holds far less than 2**53 occurrences
        columns = [self.langs.dictionary.take(pa.array(lang[at])), self.sources.dictionary.take(pa.array(source[at])), self.terms.take(pa.array(term[at])).cast(pa.string()), pa.array(docs), pa.array(total)]
        return pa.RecordBatch.from_arrays(columns, schema=COUNTS)


def _asked(dealt: ranges.Ranges):
    def scan(batches):
        for batch in slices(batches, most=SEGMENT_BYTES):
            yield ranges.batch_of(ranges.questions(Segment(batch).keys(), dealt))

    return scan


def at_least(dealt: ranges.Ranges, least: int):
    """What a piece answers: for each of a segment's cells, whether its total reaches ``least`` (below 2**16)."""

    def of(bodies):
        total, asked = np.zeros(1 << dealt.log_cells, np.uint16), []
        for seg, body in bodies:
            at, n = ranges.unpacked(body)
            total[at] += np.minimum(n, 65535 - total[at])
            asked.append((seg, at))
        for seg, at in asked:
            yield seg, np.uint32(len(at)).tobytes() + zlib.compress(np.packbits(total[at] >= least).tobytes(), 1)

    return of


def possible(keys: np.ndarray, root: str, dealt: ranges.Ranges) -> np.ndarray:
    """Which keys of a segment may reach the least frequency; all of them where it has no answer."""
    found = ranges.answer_rows(root, ranges.name_of(keys)) if len(keys) else {}
    keep = np.ones(len(keys), bool)
    for row in range(dealt.depth):
        at, back = np.unique(dealt.cells(keys, row), return_inverse=True)
        parts = [np.unpackbits(np.frombuffer(zlib.decompress(body[4:]), np.uint8), count=int.from_bytes(body[:4], "little")) for (r, _), body in found.items() if r == row]
        if sum(map(len, parts)) != len(at):
            return np.ones(len(keys), bool)
        if len(at):
            keep &= np.concatenate(parts)[back].astype(bool)
    return keep


def _counted(root: str, dealt: ranges.Ranges):
    def scan(batches):
        for batch in slices(batches, most=SEGMENT_BYTES):
            segment = Segment(batch)
            yield segment.counts(possible(segment.keys(), root, dealt))

    return scan


def term_counts(docs: DataFrame, least: int = 3) -> DataFrame:
    """Documents and occurrences of each (lang, source, term), exact for terms in at least ``least`` documents of the language.

    Terms are runs of ASCII letters (in small ones) and of anything beyond ASCII. Of other terms some, those
    whose sketched frequency is too high, are there as well. Documents of one task are counted together
    before the shuffle, so a source with a third of all rows sends no more rows than another.
    """
    narrow = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = ranges.ranges_for(size // 64)
    root = ranges.answers(narrow.mapInArrow(_asked(dealt), ranges.DDL), at_least(dealt, least))
    partial = narrow.mapInArrow(_counted(root, dealt), COUNTS_DDL)
    return partial.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def share(count: Column, size: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (size + terms)), whatever the size."""
    whole = (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")).cast("decimal(30,0)")
    return F.call_function("div", whole, (size + terms).cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q) * (p - q) / q); shares and their squared difference fit 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _total(of: Column) -> Column:
    return F.sum(of.cast("decimal(20,0)")).cast("decimal(38,0)")


def divergence(docs: DataFrame, least: int = 3, terms_each: int = 200) -> DataFrame:
    """Pairs of sources by how far they diverge, and each source's terms by how far they stand out in their language.

    Null texts, languages and sources count as ''. A language keeps the terms of at least ``least`` of its
    documents; with ``p`` the share of a source and ``q`` that of the other source (part ``pair``, summed over
    all kept terms, every rank) or of the language (part ``term``, ranks to ``terms_each``), a term's value is
    floor((p - q)**2 / q). Columns: lang, source, part, item, value, rank (ties in ``item``'s byte order).
    Repeated rows are documents of their own. Every source that occurs has its pairs, one without terms
    too; a language that keeps no term has the value 0. Texts may be of any length. An empty table gives
    no rows. Nothing goes through the driver; a sum beyond 64 bits is an error.
    """
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    by_term = Window.partitionBy("lang", "term")
    counted = term_counts(docs, least).withColumn("lang_docs", F.sum("docs").over(by_term)).withColumn("lang_n", F.sum("n").over(by_term))
    kept = written(counted.where(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n"), "term-counts")

    of_lang = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_size"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    sized = groups.join(sizes, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    none = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("size"), F.col("terms")))
    sized = written(sized.select("lang", "source", "size", "terms", "lang_size", none.alias("p0")), "source-sizes")

    shared = kept.join(sized, ["lang", "source"]).select("lang", "source", "term", "p0", share(F.col("n"), F.col("size"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_size"), F.col("terms")).alias("q"))
    shares = written(shared, "term-shares")
    p, q, p0 = F.col("p"), F.col("q"), F.col("p0")

    a = shares.select("lang", "term", "source", "p", "p0")
    b = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = a.join(b, ["lang", "term"]).where(F.col("source") != F.col("item"))
    more = gap(p, q) - gap(p, F.col("q0")) - gap(p0, q) + gap(p0, F.col("q0"))
    parts = [both.groupBy("lang", "source", "item").agg(_total(more).alias("value"))]
    # For each source, how many terms have each share; then what they differ by from a source that lacks them.
    levels = shares.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("m"))
    other = sized.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")).where("q0 IS NOT NULL")
    beside = levels.join(other, "lang").where(F.col("source") != F.col("item"))
    lone = F.col("m").cast("decimal(18,0)")
    forth = (gap(p, F.col("q0")) - gap(p0, F.col("q0"))).cast("decimal(20,0)") * lone
    back = (gap(F.col("q0"), p) - gap(F.col("q0"), p0)).cast("decimal(20,0)") * lone
    either = beside.groupBy("lang", "source", "item").agg(F.sum(forth).cast("decimal(38,0)").alias("forth"), F.sum(back).cast("decimal(38,0)").alias("back"))
    parts.append(either.select("lang", "source", "item", F.col("forth").alias("value")))
    parts.append(either.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    pairs = sized.select("lang", "source", "terms", "p0").join(sized.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), "lang").where(F.col("source") != F.col("item"))
    base = F.coalesce(gap(p0, F.col("q0")).cast("decimal(19,0)") * F.col("terms").cast("decimal(19,0)"), F.lit(0))
    parts.append(pairs.select("lang", "source", "item", base.cast("decimal(38,0)").alias("value")))
    summed = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = shares.where(p > q).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(p, q).alias("value"))
    return ranked.unionByName(terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms_each))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), groups AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
per AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM per GROUP BY lang, source),
every AS (
  SELECT g.lang, g.source, k.term, coalesce(per.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(per.n, 0) + 1)) // (coalesce(s.total, 0) + l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN sizes s USING (lang, source) LEFT JOIN per USING (lang, source, term)
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
  FROM every WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
