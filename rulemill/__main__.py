"""Search from the command line: python -m rulemill WORDS --sf-dir DIR [--domain D] [--threshold T] [--limit N]"""

import argparse

from pyspark.sql import SparkSession

from rulemill import model
from rulemill.operators import search
from rulemill.session import table


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    parser = argparse.ArgumentParser(prog="rulemill")
    parser.add_argument("query")
    parser.add_argument("--sf-dir", required=True)
    parser.add_argument("--domain")
    parser.add_argument("--threshold", type=float, default=0.3)
    parser.add_argument("--limit", type=int, default=5)
    got = parser.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    found = search.search(model.rules(spark, got.sf_dir), got.query, "unit_no", table(spark, got.sf_dir, "relations"), threshold=got.threshold, domain=got.domain)
    lines = [f"{r.score:.3f} {r.cited}" for r in search.top(found, got.limit).select("score", search.citation().alias("cited")).collect()]
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()
