"""Other columns, of any name that the operators use inside, pass through or stay out of the way."""

import pytest
from pyspark.sql import functions as F

from contourlake.llm.lines import drop_similar_lines
from contourlake.llm.media import media_columns
from contourlake.llm.ngram_join import one_of_each_group
from contourlake.llm.packing import pack
from contourlake.llm.pieces import count_tokens, encode_texts
from contourlake.llm.quality import judged, keep_good
from contourlake.llm.sharding import shard
from contourlake.llm.substring import remove_repeats

from .fixtures import frame

NAMES = ("id", "n", "token", "line", "place", "doc", "anchor", "run", "least", "at", "h", "group", "component", "copies", "text_hash", "kept", "_id2", "a", "b", "size", "digest2", "first", "DOC", "piece", "cells")


def wide(spark):
    docs = frame(spark)
    return docs.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES if n.lower() != "doc" or n == "doc"))


def test_filters_keep_them(spark):
    docs = wide(spark)
    for of in (keep_good, drop_similar_lines, one_of_each_group, remove_repeats):
        out = of(docs)
        assert out.columns == docs.columns, of
        rows = out.collect()
        assert rows and all(r["token"] == "own token" and r["id"] == "own id" for r in rows), of


def test_others_leave_them(spark):
    docs = wide(spark)
    plain = frame(spark)
    assert pack(docs).count() == pack(plain).count()
    assert count_tokens(docs).count() == encode_texts(docs).count() == judged(docs).count() == docs.count()
    assert shard(docs, "doc_id", [1.0] * 3).select("n", "slot").count() == docs.count()
    assert media_columns(docs)[0].where("n = 'own n'").count() == docs.count()


def test_names_that_cannot_be(spark):
    for of, name in ((drop_similar_lines, "_places"), (remove_repeats, "spans"), (keep_good, "_hash")):
        with pytest.raises(ValueError):
            of(frame(spark).withColumn(name, F.lit(1)))
