"""Sources and sinks: CSV scans with explicit schemas, dataset round trip,
metric appends, iteration history, importance."""

import datetime as dt

from pyspark.sql import functions as F

from shelfcast.sources import files


def test_sales_csv_columns_and_types(spark, tmp_dir):
    p = tmp_dir + "/train.csv"
    with open(p, "w") as f:
        f.write("id,date,store_nbr,item_nbr,unit_sales,onpromotion\n")
        f.write("0,2016-01-01,1,103665,7.0,\n1,2016-01-02,2,105574,1.5,True\n")
    df = files.read_sales_csv(spark, p)
    assert df.columns == ["date", "store_nbr", "item_nbr", "unit_sales", "onpromotion"]
    rows = df.collect()
    assert rows[0].date == dt.date(2016, 1, 1) and rows[0].onpromotion is None
    assert rows[1].onpromotion is True and rows[1].item_nbr == 105574


def test_dims_csv(spark, tmp_dir):
    with open(tmp_dir + "/stores.csv", "w") as f:
        f.write("store_nbr,city,state,type,cluster\n1,Quito,Pichincha,D,13\n")
    with open(tmp_dir + "/items.csv", "w") as f:
        f.write("item_nbr,family,class,perishable\n96995,GROCERY I,1093,0\n")
    assert files.read_stores_csv(spark, tmp_dir + "/stores.csv").collect()[0].cluster == 13
    assert files.read_items_csv(spark, tmp_dir + "/items.csv").collect()[0].perishable == 0


def test_dataset_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(dt.date(2016, m, 1), m, float(m)) for m in range(1, 13)],
                               "date date, month int, unit_sales double")
    files.save_dataset(df, tmp_dir, "x")
    back = files.load_dataset(spark, tmp_dir, "x")
    assert sorted(tuple(r) for r in back.select("date", "month", "unit_sales").collect()) == \
        sorted(tuple(r) for r in df.collect())
    # partition pruning on month
    plan = back.filter(F.col("month") == 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_metrics_append_and_history(spark, tmp_dir):
    m = spark.createDataFrame([("r1", "rmse", 1.0)], "run string, metric string, value double")
    files.append_metrics(m, tmp_dir + "/metrics")
    files.append_metrics(m, tmp_dir + "/metrics")        # a retried run replaces its rows
    files.append_metrics(m.withColumn("run", F.lit("r2")), tmp_dir + "/metrics")
    assert spark.read.parquet(tmp_dir + "/metrics").count() == 2
    h = spark.createDataFrame([("r", 1, "training", 2.0), ("r", 1, "valid", 3.0), ("r", 2, "training", 1.5)],
                              "run string, iteration int, dataset string, rmse double")
    w = files.history_wide(h).collect()
    assert [tuple(r) for r in w] == [("r", 1, 2.0, 3.0), ("r", 2, 1.5, None)]
    files.save_history(h, tmp_dir + "/hist")
    assert spark.read.option("header", True).csv(tmp_dir + "/hist").count() == 2
