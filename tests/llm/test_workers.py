"""Workers that can't import the package, and sessions without a shared folder."""

import pytest

from siglume.llm import common


def test_kernels_travel_by_value(tmp_path):
    from tests.test_executors import run_apart

    out = run_apart(
        """
        import json
        from siglume.llm import bpe, jaccard_join, line_dedup, pii, quality_classifier, quality_rules, suffix_dedup
        docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 97}" for j in range(90)), "en", "s") for k in range(30)], "doc_id long, text string, lang string, source string")
        labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
        print(quality_rules.rate(docs).count(), line_dedup.dedup_lines(docs).count(), pii.replace(docs, "k").count(), suffix_dedup.dedup_substrings(docs).count(), quality_classifier.classify(docs, labels).count(), jaccard_join.components(docs).count())
        words = {"model": {"vocab": {c: k for k, c in enumerate(bpe.byte_alphabet())} | {"ab": 256}, "merges": ["a b"]}}
        json.dump(words, open("vocabulary.json", "w"))
        named = docs.withColumn("text", F.concat(F.lit("Mr Smith, 漢字 ab: "), "text"))
        print(bpe.encode_documents(named, "vocabulary.json").where("round_trip").count(), pii.replace(named, "k").where("text not like '%Smith%'").count())
        """,
        tmp_path,
    )
    assert out.split() == ["30"] * 8


class _Session:
    """What ``scratch_root`` asks of a session."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://cluster:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_root(_Session())


def test_scratch_goes(spark):
    df = common.materialize(spark.range(3), "t")
    at = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(at)
    common.discard(df)
    assert not fs.exists(at)
