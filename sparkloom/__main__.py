"""``python -m sparkloom measure|change|report FILE...``: tables of transaction exports on the console."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import amounts
from sparkloom.operators import change
from sparkloom.operators.measure import entropy, measure
from sparkloom.sources import exports


def tables(command: str, txs: DataFrame) -> dict[str, DataFrame]:
    if command == "measure":
        found = measure(txs)
        return {"values": found.orderBy("axis", F.desc("n")), "entropy": entropy(found).orderBy(F.desc("entropy_bits"))}
    if command == "change":
        out = {"agreement": change.agreement_matrix(txs).orderBy("name_a", "name_b")}
        for name, label in change.LABELS.items():
            out[name] = change.rates(change.labelled(txs, label()), {k: f() for k, f in change.WITHIN.items()}).orderBy("axis")
        return out
    ranked = txs.withColumn("ranked", amounts.partitions())
    bits = F.round(amounts.ambiguity_bits(F.col("ranked")), 3).alias("ambiguity_bits")
    return {"report": ranked.select("txid", F.size("vin").alias("n_in"), F.size("vout").alias("n_out"), bits, amounts.partition_signal(F.col("ranked"))["payment"].alias("payment")).orderBy("txid")}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    parser.add_argument("command", choices=("measure", "change", "report"))
    parser.add_argument("files", nargs="+")
    parser.add_argument("--rows", type=int, default=100, help="rows shown of each table")
    asked = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    for name, table in tables(asked.command, exports.load_unique(spark, *asked.files)).items():
        print(name)
        table.show(asked.rows, truncate=False)


if __name__ == "__main__":
    main()
