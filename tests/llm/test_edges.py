"""Every operator and stage on awkward tables: nulls, empty and very long texts, repeated rows, clashing columns, no rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyledger.llm import decontaminate, langid, media_png, quality_cnn, secret_scan, sentencepiece_viterbi, simhash, substring_dedup, token_files, warc_index
from skyledger.llm.queries import tokenizer_path

LONG = "Some words, again and again. " * 40_000
ROWS = [(1, None), (2, ""), (2, ""), (None, "no id"), (None, None), (3, LONG), (4, LONG), (5, "x" * 100_000), (6, " \t\n"), (7, "password = abcdefghijk")]
CLASHES = ("id", "row", "run", "fp", "ids", "score", "label", "rank", "part", "base", "spans", "component", "first", "n_words", "start", "n", "path", "size", "digest", "record", "latest", "media", "frame", "words", "__n_words", "__spans", "__items", "__row", "__base", "__keep", "__id", "__fp", "key", "hot_latest")


@pytest.fixture(scope="module")
def awkward(make_docs):
    return make_docs(ROWS).withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def tables(spark, sf):
    return {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark")}


def cases(tables):
    bpe, pieces = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")

    def tokens(docs):
        return token_files.read_token_files(docs.sparkSession, *token_files.write_token_files(docs, bpe))

    def warc(docs):
        pages = docs.withColumn("html", F.col("text"))
        folder = warc_index.write_archives(pages, id_col="doc_id", url_col="source")
        return warc_index.read_captures(warc_index.lookup(warc_index.build_index(docs.sparkSession, folder), pages, "source"))

    return {
        "simhash": simhash.near_duplicates, "tokens": tokens, "quality": lambda d: quality_cnn.score_quality(d, quality_cnn.fit_quality(d, tables["labels"])), "media": lambda d: media_png.media_features(media_png.store_media(d)),
        "decontaminate": lambda d: decontaminate.report(d, tables["benchmark"]), "secrets": secret_scan.report, "warc": warc, "pieces": lambda d: sentencepiece_viterbi.round_trip(d, pieces), "substring": substring_dedup.remove_repeats,
        "languages": lambda d: langid.predict_languages(d, langid.fit_languages(d)),
    }


@pytest.mark.parametrize("name", ["simhash", "tokens", "quality", "media", "decontaminate", "secrets", "warc", "pieces", "substring", "languages"])
def test_operator(awkward, tables, name):
    found = cases(tables)[name](awkward)
    assert found.count() == len(ROWS)
    assert cases(tables)[name](awkward.limit(0)).count() == 0
    nothing = awkward.select(*(F.lit(None).cast(k).alias(c) for c, k in awkward.dtypes)).limit(3)
    assert cases(tables)[name](nothing).count() == 3


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage(spark, awkward, sf, name, stage):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars", *(c for c in CLASHES if c.startswith("__")))
    out = stage(spark, docs, sf)
    assert 0 < out.count() <= len(ROWS)
    assert stage(spark, docs.limit(0), sf).count() == 0
    if name != "pieces":
        assert out.columns == docs.columns
    nothing = docs.select(*(F.lit(None).cast(k).alias(c) for c, k in docs.dtypes)).limit(3)
    assert stage(spark, nothing, sf).count() <= 3
