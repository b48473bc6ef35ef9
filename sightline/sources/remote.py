"""Project listings of a hosting service, as JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHAPE = "project struct<name:string,images:long,classes:map<string,long>>, versions array<struct<id:string,images:long,splits:map<string,long>>>"


def resolve(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Projects and failures from (key, workspace, project, response).

    Projects: (key, workspace, project, name, images, classes, latest_version, versions) with
    versions in order of number.  A response of another shape is a failure row (key, reason).
    """
    told = responses.withColumn("j", F.from_json("response", SHAPE))
    bad = F.col("j.project.name").isNull() | F.col("j.project.images").isNull() | F.col("j.versions").isNull()
    number = lambda v: F.try_to_number(F.element_at(F.split(v["id"], "/"), -1), F.lit("999999999")).cast("int")
    listed = F.array_sort(F.transform("j.versions", lambda v: F.struct(number(v).alias("version"), v["images"].alias("images"), v["splits"].alias("splits"))), lambda a, b: a["version"] - b["version"])
    rows = told.withColumn("bad", bad).withColumn("vs", F.when(~bad, listed))
    rows = rows.withColumn("bad", F.col("bad") | F.coalesce(F.exists("vs", lambda v: v["version"].isNull()), F.lit(False)))
    good = rows.filter("not bad").select("key", "workspace", "project", "j.project.name", "j.project.images", F.map_from_entries(F.array_sort(F.map_entries("j.project.classes"))).alias("classes"), F.try_element_at("vs", F.lit(-1))["version"].alias("latest_version"), F.col("vs").alias("versions"))
    return good, rows.filter("bad").select("key", F.concat(F.lit("unexpected response for "), F.concat_ws("/", "workspace", "project")).alias("reason"))


def project_slugs(workspaces: DataFrame) -> DataFrame:
    """(key, slug) of the projects a workspace response lists."""
    told = workspaces.select("key", F.explode(F.from_json("response", "workspace struct<projects:array<struct<id:string>>>")["workspace"]["projects"]).alias("p"))
    return told.select("key", F.substring_index("p.id", "/", -1).alias("slug"))
