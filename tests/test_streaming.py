"""Streaming scorer: rows scored from arriving files equal the batch scores."""

import uuid

from pyspark.sql import functions as F

from shelfcast.operators import gbt
from shelfcast.plans import prepare
from shelfcast.sources import star
from shelfcast.streaming import score as S
from conftest import SF_SMALL


def test_stream_equals_batch(spark, tmp_dir):
    ds = prepare.load(spark, SF_SMALL)
    mf = prepare.tree_frames(ds)
    fit = gbt.fit(mf.train, "stream", max_iter=2, max_depth=3, min_instances=20, early_stopping=False)
    st, it = star.stores(spark, SF_SMALL), star.items(spark, SF_SMALL)
    arriving = prepare.sample.sample_perishable(star.sales(spark, SF_SMALL), it,
                                                prepare.TEST_START, prepare.TEST_END)
    src = f"{tmp_dir}/in"
    arriving.filter(F.month("date") <= 6).write.parquet(src + "/part1")
    arriving.filter(F.month("date") > 6).write.parquet(src + "/part2")
    scored = S.scoring_stream(spark, src + "/*", st, it, mf.stats, mf.encoder, fit)
    q = S.start_scoring(scored, f"{tmp_dir}/out", "t" + uuid.uuid4().hex[:8])
    q.awaitTermination(300)
    got = spark.read.parquet(f"{tmp_dir}/out")
    want = gbt.score(fit, mf.test)
    key = ["date", "store_nbr", "item_nbr"]
    a = sorted((r.date, r.store_nbr, r.item_nbr, round(r.prediction, 9)) for r in got.collect())
    b = sorted((r.date, r.store_nbr, r.item_nbr, round(r.prediction, 9)) for r in want.select(*key, "prediction").collect())
    assert a == b and len(a) > 0
