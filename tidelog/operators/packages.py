"""Cases with their evidence as a package that another workspace can take in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stored import written
from .cases import IDENTITY, add_evidence, missing

TABLES = ["evidence", "cases"]


class PackageError(ValueError):
    """A package that is not as it was written; nothing of it is taken in."""


def fingerprint(df: DataFrame) -> DataFrame:
    """rows and digest of a table, whatever the order and the parts of its rows: the sum of 60 bits of each row's SHA-256."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    number = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest"))


def export(cases: DataFrame, evidence: DataFrame, path: str) -> None:
    """Writes cases, the evidence that they name and a manifest of both. A case that names evidence which isn't there is an error."""
    if not missing(cases, evidence).isEmpty():
        raise PackageError("a case names evidence that the store lacks")
    named = cases.select(F.explode("evidence_ids").alias("evidence_id")).distinct()
    evidence.join(named, "evidence_id", "left_semi").write.parquet(f"{path}/evidence")
    cases.write.parquet(f"{path}/cases")
    tables = [fingerprint(cases.sparkSession.read.parquet(f"{path}/{t}")).select(F.lit(t).alias("table"), "rows", "digest") for t in TABLES]
    tables[0].unionByName(tables[1]).coalesce(1).write.json(f"{path}/manifest")


def verified(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The package's tables; PackageError if rows, digests or references are not as the manifest says."""
    stated = {r.table: (r["rows"], r.digest) for r in spark.read.schema("table string, rows long, digest string").json(f"{path}/manifest").collect()}
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}
    wrong = [t for t, df in tables.items() if stated.get(t) != tuple(fingerprint(df).first())]
    if wrong:
        raise PackageError(f"not as written: {', '.join(wrong)}")
    if not missing(tables["cases"], tables["evidence"]).isEmpty():
        raise PackageError("a case names evidence that the package lacks")
    return tables


def take_in(path: str, cases: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stores' cases and evidence with those of a package. All of it is verified first.

    Evidence that the store has by file, line and timestamp keeps the store's number, other evidence is numbered on; references follow. A case that
    the store has as it is stays one; another case of a taken id gets the package's mark behind its id, once. So taking in a package twice changes nothing. Null identities are equal.
    """
    spark = cases.sparkSession
    package = verified(spark, path)
    mark = fingerprint(package["cases"]).select(F.substring(F.sha2("digest", 256), 1, 8)).first()[0]
    store = written(add_evidence(evidence, package["evidence"].select(evidence.columns)), "evidence")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"p.{c}")) for c in IDENTITY]
    numbers = store.groupBy(*IDENTITY).agg(F.min("evidence_id").alias("now"))
    renamed = package["evidence"].alias("p").join(numbers.alias("s"), same).select(F.col("p.evidence_id").alias("was"), "now")
    refs = package["cases"].select("case_id", F.posexplode("evidence_ids").alias("place", "was")).join(renamed, "was")
    lists = refs.groupBy("case_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "now"))), lambda r: r["now"])).alias("ids"))
    incoming = package["cases"].join(lists, "case_id", "left").withColumn("evidence_ids", F.coalesce("ids", F.array().cast("array<string>"))).select(cases.columns)
    equal = [F.col(f"i.{c}").eqNullSafe(F.col(f"o.{c}")) for c in cases.columns]
    changed = incoming.alias("i").join(cases.alias("o"), equal, "left_anti")
    taken = cases.select("case_id", F.lit(True).alias("taken")).distinct()
    named = changed.join(taken, "case_id", "left").withColumn("case_id", F.when(F.col("taken"), F.concat("case_id", F.lit(f"-{mark}"))).otherwise(F.col("case_id")))
    return cases.unionByName(named.select(cases.columns).join(taken, "case_id", "left_anti")), store
