"""python -m netexp STAGE --networks a,b --data DIR --out DIR: the study's stages over several networks."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from netexp.plans import pipeline, reports


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="netexp", description=__doc__)
    parser.add_argument("stage", choices=["prepare", "sample", "sample_hop2", "summarise", "boundary", "estimate"])
    parser.add_argument("--networks", required=True, help="names, separated by commas")
    parser.add_argument("--data", default="data", help="folder of the networks' files, one folder each")
    parser.add_argument("--out", required=True, help="folder of the prepared networks and results")
    parser.add_argument("--size", type=int, default=500, help="nodes an arm")
    parser.add_argument("--sims", type=int, default=100)
    parser.add_argument("--steps", type=int, default=200_000, help="steps of a chain")
    parser.add_argument("--sizes", default="50,100,150,200,250,300,350,400,450,500", help="sweep")
    parser.add_argument("--taus", default="", help="effect sizes, separated by commas")
    parser.add_argument("--seed", type=int, default=0, help="of all draws: another seed, other samples")
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("netexp").getOrCreate()
    names, sizes, taus = a.networks.split(","), [int(x) for x in a.sizes.split(",")], [float(x) for x in a.taus.split(",") if x]
    at = lambda n: f"{a.out}/{n}"
    if a.stage == "prepare":
        def prepared(n):
            edges, extra = pipeline.network_input(spark, n, a.data)
            return pipeline.prepare(spark, edges, at(n), n, n != "pokec", extra)  # two steps from every node of the largest network are not kept

        pipeline.each(prepared, names, f"{a.out}/table1")
    elif a.stage == "sample":
        for n in names:
            pipeline.sample(spark, at(n), n, a.size, a.sims, a.steps, seed=a.seed)
    elif a.stage == "sample_hop2":
        for n in names:
            pipeline.sample_hop2(spark, at(n), n, a.size, a.sims, a.steps, sizes, a.seed)
    elif a.stage == "summarise":
        tables = {n: pipeline.summarise(spark, at(n), n, sizes, a.sims, a.size, a.seed) for n in names}
        for name in ("sweep", "table2", "representativeness"):
            pipeline.sinks.save_table(reports.labelled_union({n: t[name].drop("network") for n, t in tables.items()}), f"{a.out}/{name}")
    elif a.stage == "boundary":
        pipeline.each(lambda n: pipeline.boundary(spark, at(n), n, sizes, a.sims, a.steps, a.seed), names, f"{a.out}/table3")
    else:
        tables = {n: pipeline.estimate_tables(spark, at(n), n, a.size, a.sims, taus or None, a.seed) for n in names}
        for name in ("ate", "cate"):
            pipeline.sinks.save_table(reports.labelled_union({n: t[name] for n, t in tables.items()}), f"{a.out}/{name}")


if __name__ == "__main__":
    main()
