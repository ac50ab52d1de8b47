"""Queries of a caller's own functions, maps and digests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import extend as ops
from ..functions.stats import quotient
from ..sources.shared import folder
from . import views as v
from .registry import query


@query(" select event_id, bet_amount - win_amount as loss from bets", (v.BETS,), "loss")
def map_partitions(spark, sf):
    return ops.map_partitions(v.bets(spark, sf).select("event_id", "bet_amount", "win_amount"), lambda x: pd.DataFrame({"event_id": x["event_id"], "loss": x["bet_amount"] - x["win_amount"]}), "event_id long, loss double")


@query("select n_nationkey::bigint as key, n_name as name from nation")
def map_files(spark, sf):
    """Files of a format of one's own: fields between bars, records between semicolons."""
    path = folder(spark, "bars")
    rows = v.table(spark, sf, "nation").select(F.concat_ws("|", "n_nationkey", "n_name").alias("value"))
    rows.repartition(3).write.option("lineSep", ";").text(path)

    def parse(name: str, content: bytes) -> pd.DataFrame:
        fields = [x.split("|") for x in content.decode().split(";") if x]
        return pd.DataFrame({"key": [int(x[0]) for x in fields], "name": [x[1] for x in fields]})

    return ops.map_files(spark, f"{path}/*.txt", parse, "key long, name string")


@query(" select event_id, bet_amount - win_amount as loss, (bet_amount - win_amount) / bet_amount as loss_share from bets", (v.BETS,), "loss loss_share")
def feature_registry(spark, sf):
    features = ops.FeatureRegistry()
    features.register("loss_share", quotient(F.col("loss"), F.col("bet_amount")), ("loss", "bet_amount"))
    features.register("loss", F.col("bet_amount") - F.col("win_amount"))
    return features.compute(v.bets(spark, sf), ["loss_share"]).select("event_id", "loss", "loss_share")


@query(" select transaction_id, case when transaction_id % 3 = 0 then '-' else device end as device, channel, status from tx", (v.TX,))
def merge_maps(spark, sf):
    a = F.create_map(F.lit("device"), F.col("device"), F.lit("channel"), F.col("channel"))
    b = F.when(F.col("transaction_id") % 3 == 0, F.create_map(F.lit("device"), F.lit("-"), F.lit("status"), F.col("status"))).otherwise(F.create_map(F.lit("status"), F.col("status")))
    return v.transactions(spark, sf).select("transaction_id", ops.merge_maps(a, b).alias("m")).select("transaction_id", *[F.col("m")[x].alias(x) for x in ("device", "channel", "status")])


@query("select c_custkey, md5(c_name) as md5, sha1(c_name) as sha1, sha256(c_name) as sha256 from customer")
def digests(spark, sf):
    return v.table(spark, sf, "customer").select("c_custkey", *[ops.digest(F.col("c_name"), x).alias(x) for x in ("md5", "sha1", "sha256")])
