"""A table whose texts are repeated under other ids costs op4 no more disk than the texts once."""

import random

from pyspark.sql import functions as F

from lineagelake.llm import ngram_join
from lineagelake.llm.common import written


def test_copies_in_other_tasks_do_not_fill_the_filter(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(1100)) for _ in range(300)]
    rows = [(1000 * k + i, t) for k in range(2) for i, t in enumerate(texts)]
    rows += [(5000, texts[7] + " more"), (5001, None), (5002, ""), (7, texts[8]), (7, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(2, "doc_id")
    seen, make = [], ngram_join._filters
    monkeypatch.setattr(ngram_join, "REPEATED_BITS", 20)
    monkeypatch.setattr(ngram_join, "_filters", lambda *how: seen.append(make(*how)) or seen[-1])
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    assert seen[0].complete
    assert got == {d: 7 if d in (7, 8, 1007, 1008, 5000) else d % 1000 if d < 5000 else d for d, _ in rows}


def test_shuffle_files_go_when_a_table_is_written(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    made = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not {f for f in files() - before if f.endswith(".data")}
    assert made.count() == 7
