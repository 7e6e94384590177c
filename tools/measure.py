"""Rows per second of the decode paths and of the idempotent write, on payloads stored beforehand."""

from __future__ import annotations

import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from slotframe import fixtures as fx  # noqa: E402
from slotframe.functions.names import DISCRIMINATOR_BYTES  # noqa: E402
from slotframe.operators.decode import decode_table  # noqa: E402
from slotframe.operators.tables import write_ledger  # noqa: E402
from slotframe.plans.walker import walk_column  # noqa: E402
from slotframe.session import build_session, new_path  # noqa: E402


COPIES = {"decode_fixed": 4, "decode_string": 8, "decode_vec": 40}  # enough rows to outweigh job start


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(f"local[{cpus}]", "measure", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def timed(action) -> float:
        def once() -> float:
            start = time.perf_counter()
            action()
            return time.perf_counter() - start
        once()
        return statistics.median(once() for _ in range(3))

    def sink(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    cases = {"decode_fixed": (fx.fill_payloads(spark, sf), fx.FILL), "decode_string": (fx.text_payloads(spark, sf), fx.TEXTS),
             "decode_vec": (fx.vector_payloads(spark, sf, True), fx.VECTORS)}
    for name, (payloads, face) in cases.items():
        path = new_path(spark, name)
        copies = payloads.select("data", F.explode(F.sequence(F.lit(1), F.lit(COPIES[name]))))
        copies.select("data").repartition(int(cpus)).write.parquet(path)
        stored = spark.read.parquet(path)
        rows, layout = stored.count(), face.instructions[0]
        native = timed(lambda: sink(decode_table(stored, face, layout, keep=[])))
        walked = timed(lambda: sink(stored.select(walk_column(layout, face, F.col("data"), DISCRIMINATOR_BYTES))))
        print(f"{name}: {rows} rows, expressions {rows / native:,.0f} rows/s, row walker {rows / walked:,.0f} rows/s")

    batch, path = fx.instructions(spark, sf), new_path(spark, "ledger")
    key, order = ["transaction_signature", "outer_index"], ["indexed_at", "part", "price"]
    for label, batch_id in (("first run", 0), ("replay", 0), ("same rows as next batch", 1)):
        start = time.perf_counter()
        write_ledger(batch, path, batch_id, key, order)
        print(f"insert_if_absent, {label}: {time.perf_counter() - start:.2f} s")


if __name__ == "__main__":
    main()
