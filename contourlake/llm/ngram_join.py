"""N-gram Jaccard join: prefix filters under several global token orders, then exact verification.

Of a set of n tokens and a partner with Jaccard similarity t or more, ceil(t n) tokens are shared; so
under any global order the first n - ceil(t n) + 1 tokens of both sets have one in common. Candidates
must share prefix tokens under each of three orders: (1) tokens with a hash below ``LOW`` by rising
frequency, as a sketch estimates it, then the others by hash; (2) and (3) by two hashes. Order 1 asks
for the frequencies of the low tokens only, of which a set has more than its prefix takes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges
from .components import apart, by_unit, common_counts, components, joined_within, linking
from .kernels import LOWER, grams, inside, mix, slices, text_buffer, words
from .store import table, written

#: Tokens below have their frequency estimated; bytes of text for each of them, at least.
LOW, BYTES_EACH = np.uint64(1 << 63), 8
SECOND = np.uint64(0x5851F42D4C957F2D)
#: Ids that are broadcast at most, 16 MB; where more sets are asked for, sets are shuffled to their ids.
MOST_TOLD = 1 << 21


def shingle_sets(batch: pa.RecordBatch, n: int, column: int = 1) -> list[np.ndarray]:
    """For each text, the sorted 64-bit hashes of its distinct n-word shingles, A-Z lowered.

    A text of fewer words has its whole sequence as one; one without words has none.
    """
    data, at = text_buffer(batch.column(column))
    w = words(LOWER[data], at)
    h = w.hashes()
    g, ok = grams(h, n), inside(w.bounds, n, len(h))
    out = []
    for low, high in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if high - low >= n:
            out.append(np.unique(g[low : high - n + 1]))
        else:
            out.append(grams(h[low:high], high - low) if high > low else h[:0])
    assert not len(ok) or len(ok) == len(g)
    return out


def prefix_length(n: int, num: int, den: int) -> int:
    return n - (num * n + den - 1) // den + 1


def region(n: int, num: int, den: int) -> int:
    """How many of a set's tokens, the least under the second order, the bound on the overlap looks at."""
    return max(prefix_length(n, num, den), -(-35 * n // 100))


def _low(batches, n: int):
    """Parts of text, each with its sets and how many low tokens these have; and the keys: all low tokens."""
    for batch in slices(batches):
        sets = shingle_sets(batch, n)
        low = [int(np.searchsorted(s, LOW)) for s in sets]
        yield (batch, sets, low), np.concatenate([s[:k] for s, k in zip(sets, low, strict=True)])


def _first_scan(n: int, dealt: ranges.Ranges):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), *ranges.SCHEMA])

    def scan(batches):
        for segment in ranges.segments(_low(batches, n)):
            for (batch, sets, _), _ in segment:
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                own = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(sets), f.type) for f in ranges.SCHEMA)], schema=schema)
            asked = ranges.batch_of(ranges.questions(ranges.joined(segment), dealt))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(asked.num_rows, schema.field(k).type) for k in range(3)), *asked.columns], schema=schema)

    return scan, f"id long, n long, digest binary, {ranges.DDL}"


def first_prefix(s: np.ndarray, low: int, classes: np.ndarray, p: int) -> np.ndarray:
    """The first ``p`` tokens of a set under the first order, but for those surely seen once, which come first.

    Without answers nothing is known of the order: then all tokens count as prefix, which any partner's prefix meets.
    """
    if low and classes[0] == ranges.UNKNOWN and (classes == ranges.UNKNOWN).all():
        return s
    once = classes < 2
    want = p - int(once.sum())
    if want <= 0:
        return s[:0]
    often = np.flatnonzero(~once)
    by_class = s[often[np.argsort(classes[often], kind="stable")[:want]]]
    return np.concatenate((by_class, s[low : low + want - len(by_class)]))


def _second_scan(n: int, num: int, den: int, told: ranges.Answers):
    """Sets with prefix tokens that others may have; sets whose whole prefix was surely seen once have no partner."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("second", pa.binary()), ("third", pa.binary()), ("tokens", pa.binary())])

    def row(i, s: np.ndarray, prefix: np.ndarray) -> tuple:
        second = (s[: region(len(s), num, den)] >> np.uint64(32)).astype(np.uint32).tobytes()
        return i, len(s), prefix.view(np.int64), second, third_prefix(s, num, den).tobytes(), s.tobytes()

    def scan(batches):
        for segment in ranges.segments(_low(batches, n)):
            classes, used = told.classes(ranges.joined(segment)), 0
            for (batch, sets, low), _ in segment:
                rows = []
                for i, s, k in zip(batch.column(0).to_pylist(), sets, low, strict=True):
                    prefix = first_prefix(s, k, classes[used : used + k], prefix_length(len(s), num, den)) if len(s) else s
                    used += k
                    if i is not None and len(prefix):
                        rows.append(row(i, s, prefix))
                yield ranges.batch_of(rows, schema)

    return scan, "id long, n long, prefix array<long>, second binary, third binary, tokens binary"


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.sort(np.concatenate((a, b)))
    return int((both[1:] == both[:-1]).sum())


def _may_link(a: np.ndarray, b: np.ndarray, n: int, m: int, num: int, den: int) -> bool:
    """Whether sets of n and m tokens, of which the least are known, can still be similar.

    Up to the lesser of both known ends everything is known; beyond it at most the smaller rest is
    shared. (32 bits of each token: equal ones stay equal, so the bound is never too low.)
    """
    if not len(np.intersect1d(a[: prefix_length(n, num, den)], b[: prefix_length(m, num, den)])):
        return False
    end = min(a[-1], b[-1])
    x, y = a[: np.searchsorted(a, end, side="right")], b[: np.searchsorted(b, end, side="right")]
    most = _common(x, y) + min(n - len(x), m - len(y))
    return den * most >= num * (n + m - most)


def _sharing(num: int, den: int):
    """Pairs that share prefix tokens under the second and the third order too, and whose overlap may suffice."""

    def scan(batches):
        for batch in batches:
            keep = []
            for n, a2, a3, m, b2, b3 in zip(*(batch.column(c) for c in ("an", "a2", "a3", "bn", "b2", "b3")), strict=True):
                a2, a3, b2, b3 = (np.frombuffer(x.as_buffer(), np.uint32) for x in (a2, a3, b2, b3))
                keep.append(_may_link(a2, b2, n.as_py(), m.as_py(), num, den) and bool(len(np.intersect1d(a3, b3))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return scan


def third_prefix(s: np.ndarray, num: int, den: int) -> np.ndarray:
    return (np.sort(mix(s ^ SECOND))[: prefix_length(len(s), num, den)] >> np.uint64(32)).astype(np.uint32)


def may_link_within(second: list[np.ndarray], third: list[np.ndarray], n: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each two members of a unit what ``_may_link`` and the third order say of a pair.

    Of equal 32-bit tokens within a set one is counted; the bound is raised by as many as both sets may lack.
    """
    prefixes = [s[: prefix_length(int(k), num, den)] for s, k in zip(second, n, strict=True)]
    ends = np.array([s[-1] for s in second])
    twice = np.array([int((s[1:] == s[:-1]).sum()) for s in second])
    rest = n[:, None] - np.stack([np.searchsorted(s, ends, side="right") for s in second])
    most = common_counts(second) + np.minimum(rest, rest.T) + np.minimum(twice[:, None], twice[None, :])
    enough = den * most >= num * (n[:, None] + n[None, :] - most)
    return enough & (common_counts(prefixes) > 0) & (common_counts(third) > 0)


UNIT = pa.schema([("token", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("id", pa.int64()), ("group", pa.int64()), ("block", pa.int32())])
UNIT_DDL = "token long, low int, high int, id long, group long, block int"


def _may_link_blocks(num: int, den: int):
    """The members of each unit that may link with another by all three orders; whole sets are asked of these only.

    Two members that share a ``lesser`` prefix token than the unit's are left to that one: its bucket is
    small, so that they were judged as a pair, or of one group, or has a unit where they meet.
    """

    def members(rows: list[tuple]):
        *_, groups, block, n, second, third, lesser = zip(*rows, strict=True)
        second, third = ([np.frombuffer(x, np.uint32) for x in column] for column in (second, third))
        may = apart(np.array(groups), np.array(block)) & may_link_within(second, third, np.array(n), num, den)
        if may.any():
            may &= common_counts([np.array(x, np.int64) for x in lesser]) == 0
        return (rows[k][: len(UNIT)] for k in np.flatnonzero(may.any(axis=0) | may.any(axis=1)).tolist())

    return by_unit(members, (*UNIT.names, "n", "second", "third", "lesser"), UNIT)


def _alike_blocks(num: int, den: int):
    """What connects the linked members of each unit, given with whole sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(rows: list[tuple]):
        ids, groups, block, tokens = zip(*rows, strict=True)
        sets = [np.frombuffer(t, np.uint64) for t in tokens]
        second = common_counts([s[: prefix_length(len(s), num, den)] for s in sets]) > 0
        candidates = second & (common_counts([third_prefix(s, num, den) for s in sets]) > 0)
        for i, j in joined_within(sets, np.array(groups), np.array(block), num, den, candidates):
            yield min(ids[i], ids[j]), max(ids[i], ids[j])

    return by_unit(links, ("id", "group", "block", "tokens"), schema)


def _alike(num: int, den: int):
    def scan(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = _common(x, y)
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return scan


def _of(sets: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """The sets that ``ids`` ask for. Up to ``MOST_TOLD`` ids are broadcast, whatever Spark's limit, so that no other sets travel."""
    asked = written(ids.select("id").distinct(), "asked")
    told = F.broadcast(asked) if asked.count() <= MOST_TOLD else asked
    return sets.select("id", *columns).join(told, "id", "left_semi")


def _verified(sets: DataFrame, num: int, den: int):
    """Those of the distinct pairs (a, b) that are similar."""

    def verified(pairs: DataFrame) -> DataFrame:
        second = sets.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("second").alias("b2"), F.col("third").alias("b3"))
        first = sets.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("second").alias("a2"), F.col("third").alias("a3"))
        shared = written(pairs.select("a", "b").join(second, "b").join(first, "a").mapInArrow(_sharing(num, den), "a long, b long"), "shared-prefixes")
        asked = shared.select(F.col("a").alias("id")).unionByName(shared.select(F.col("b").alias("id")))
        whole = written(_of(sets, asked, "tokens"), "asked-sets")
        both = shared.join(whole.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b").join(whole.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
        return written(both.mapInArrow(_alike(num, den), "a long, b long"), "links")

    return verified


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, num: int = 90, den: int = 100, rounds: int = 4) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row: the least id that links reach.

    Texts link when den * |intersection| >= num * |union| of their shingle sets. Equal sets are one
    class, whose least id speaks for it. Texts without words and null texts have no shingle and link
    with nothing; a null id links with nothing and has no component. Rows that share an id each get
    the component of their own text. An empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = ranges.ranges_for(size // BYTES_EACH)
    scan, schema = _first_scan(words_each, dealt)
    first = written(narrow.mapInArrow(scan, schema), "shingle-scan")
    told = ranges.Answers(ranges.answers(first.where("seg IS NOT NULL"), ranges.counts_in(dealt)), dealt)
    texts = first.where("seg IS NULL").select("id", "n", "digest")
    speakers = texts.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("speaker"))
    scan, schema = _second_scan(words_each, num, den, told)
    sets = written(narrow.mapInArrow(scan, schema), "sets")
    speaking = sets.select("id", "n", "prefix").join(speakers.select(F.col("speaker").alias("id")).distinct(), "id", "left_semi")
    postings = written(speaking.select(F.explode("prefix").alias("token"), "id", "n"), "postings")

    verified = _verified(sets, num, den)

    def verified_blocks(units: DataFrame) -> DataFrame:
        unit = ("token", "low", "high")
        known = units.join(_of(sets, units, "n", "second", "third", "prefix"), "id").withColumn("lesser", F.expr("filter(prefix, x -> x < token)")).drop("prefix")
        members = written(known.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_may_link_blocks(num, den), UNIT_DDL), "block-candidates")
        whole = members.join(_of(sets, members, "tokens"), "id").repartition(*unit).sortWithinPartitions(*unit)
        return written(whole.mapInArrow(_alike_blocks(num, den), "a long, b long").distinct(), "similar-blocks")

    links = linking(postings, verified, f"{den} * least(n, m) >= {num} * greatest(n, m)", verified_blocks, rounds)
    classes = texts.join(speakers, "digest", "left")
    own = F.when(F.col("n") > 0, F.coalesce("speaker", "id")).otherwise(F.col("id"))
    named = classes.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("speaker"))
    if links is None:
        return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("speaker")).alias("component_id"))
    groups = components(links)
    joined = named.join(groups, named["speaker"] == groups["id"], "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "speaker")).alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their group of similar texts, unchanged.

    Texts without words, and rows without an id, stay. Rows that share an id are one document: they
    stay if one of their texts leads its group.
    """
    lead = jaccard_groups(docs, id_col, text_col, **options).where("doc_id = component_id").select(F.col("doc_id").alias("_lead")).distinct()
    return docs.where(F.col(id_col).isNotNull()).join(lead, docs[id_col].cast("long") == lead["_lead"], "left_semi").unionByName(docs.where(F.col(id_col).isNull()))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
