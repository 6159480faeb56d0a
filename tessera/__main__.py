"""python -m tessera status|ask|conflicts FOLDER [TASK]: read a project folder and answer from it."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tessera.plans import index, pack
from tessera.sources import files


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("status", "ask", "conflicts") or (args[0] == "ask" and len(args) < 3):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    project = index.build(files.read_project(spark, args[1]))
    if args[0] == "status":
        project.status().orderBy("kind").show(100, False)
    elif args[0] == "conflicts":
        project.conflicts().show(100, False)
    else:
        made = pack.build(project, " ".join(args[2:]))
        print(pack.summary(made))
        print(pack.render(made))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
