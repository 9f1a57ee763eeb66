"""Ids that doubles can't hold, beside null ones, in every operator on documents; messages and vectors have theirs elsewhere."""

from pyspark.sql import functions as F

from llm.importance import resample
from llm.jaccard_join import keep_one_of_each, ngram_jaccard_components
from llm.kd_shards import kd_shards
from llm.mixing import mix
from llm.packing import pack
from llm.ppm import identify
from llm.pseudonyms import pseudonymise

BIG = 2**53 + 1
DOC = "doc_id long, text string, lang string, source string"


def test_large_ids_stay_exact_beside_nulls(spark):
    rows = [(BIG, "one text of some words here", "en", "s"), (None, "another text of other words", "en", "s"), (BIG + 2, "one text of some words here", "en", "t"), (BIG + 4, None, None, None)]
    docs = spark.createDataFrame(rows, DOC).repartition(1)
    labels = spark.createDataFrame([(BIG, 1), (BIG + 2, 0)], "doc_id long, quality int")
    learn = docs.select("lang", "text", F.xxhash64("doc_id").alias("pick"))
    found = {
        "pseudonyms": pseudonymise(docs, "k"),
        "packing": pack(docs),
        "packing with texts": pack(docs, text=True),
        "mixing": mix(docs),
        "shards": kd_shards(docs, shards=2),
        "join": ngram_jaccard_components(docs, 3, 90, 100),
        "language": identify(docs, learn),
        "resampling": resample(docs, labels),
    }
    for name, df in found.items():
        assert sorted(str(r.doc_id) for r in df.select("doc_id").collect()) == sorted(map(str, (BIG, None, BIG + 2, BIG + 4))), name
    linked = {r.doc_id: r.component_id for r in found["join"].collect()}
    assert linked[BIG] == linked[BIG + 2] == BIG and linked[BIG + 4] == BIG + 4
    assert sorted(r.doc_id or 0 for r in keep_one_of_each(docs).collect()) == [0, BIG, BIG + 4]
