"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linkweave.functions import tokens
from linkweave.functions.ids import short_id
from linkweave.operators import batches, deletes, flush, lookup, shorten
from linkweave.plans import fixtures as fx
from linkweave.plans.queries_table import current_links, request_log
from linkweave.plans.replay import replay
from linkweave.session import drop_scratch, prepare, stage


def _signed(spark, sf_dir):
    token = tokens.sign_token(F.col("user_id"), fx.TOKEN_KEY)
    signed = fx.shorten_big(spark, sf_dir).select(token.alias("token"))
    return signed.select(tokens.verify_token(F.col("token"), fx.TOKEN_KEY).alias("t")).select("t.*")


def _big_clicks(spark, sf_dir):
    """Every line item as a click on the page of its part."""
    return fx.shorten_big(spark, sf_dir).select("req_id", short_id(F.col("original_url")).alias("short_id"))


# inputs that a user has stored already; written before the clock starts
INPUTS = {
    "requests": fx.shorten_big,
    "links": lambda spark, sf: fx.links_of(fx.shorten_big(spark, sf)),
    "clicks": _big_clicks,
    "event_links": current_links,
    "event_clicks": fx.clicks,
    "log": request_log,
}


QUERIES = {
    "shorten_600k": lambda spark, sf, of: shorten.shorten_unique(of["requests"]),
    "shorten_600k_known": lambda spark, sf, of: shorten.shorten_unique(of["requests"], of["links"]),
    "resolve_600k": lambda spark, sf, of: lookup.resolve(of["clicks"], of["links"]),
    "resolve_events": lambda spark, sf, of: lookup.resolve(of["event_clicks"], of["event_links"]),
    "sign_verify_600k": lambda spark, sf, of: _signed(spark, sf),
    "assign_link_ids_600k": lambda spark, sf, of: shorten.assign_link_ids(
        of["requests"], [F.col("ts"), F.col("req_id"), F.col("original_url")]
    ),
    "group_deletes": lambda spark, sf, of: deletes.group_deletes(deletes.clean_deletes(fx.delete_requests(spark, sf))),
    "delete_batches": lambda spark, sf, of: flush.delete_batches(fx.delete_tasks(spark, sf)),
    "batch_save": lambda spark, sf, of: batches.batch_save(fx.batch_items(spark, sf)),
    "batch_save_unique": lambda spark, sf, of: batches.batch_save_unique(fx.batch_items(spark, sf)),
    "replay_events": lambda spark, sf, of: replay(of["log"]),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("linkweave-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    inputs = {name: stage(make(spark, sf_dir), name) for name, make in INPUTS.items()}
    seconds = {}
    for name, run in QUERIES.items():
        started = time.perf_counter()
        run(spark, sf_dir, inputs).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    drop_scratch(spark)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
