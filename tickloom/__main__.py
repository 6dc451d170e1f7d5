"""``python -m tickloom [--base DIR] [--format table|csv|json] "SQL"``: one statement over files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .session import Session


def main() -> None:
    p = argparse.ArgumentParser(prog="tickloom")
    p.add_argument("sql")
    p.add_argument("--base", default=".", help="where bare file names are looked for")
    p.add_argument("--format", default="table", choices=("table", "csv", "json"))
    p.add_argument("--rows", type=int, default=1000, help="rows to print at most")
    a = p.parse_args()
    import os

    spark = SparkSession.builder.appName("tickloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    r = Session(spark, os.path.abspath(a.base)).sql(a.sql)
    if r.df is None:
        print(r.message)
    elif a.format == "table":
        r.show(a.rows)
    else:
        frame = r.df.limit(a.rows).toPandas()
        print(frame.to_csv(index=False) if a.format == "csv" else frame.to_json(orient="records", lines=True, date_format="iso"), end="")


if __name__ == "__main__":
    main()
