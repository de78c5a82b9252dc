"""A project folder: solutions name system projects, plc projects below those list the files that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECT = """struct<
    POU: struct<_Name: string, _POUType: string, Declaration: string, Implementation: struct<ST: string, FBD: string, CFC: string, SFC: string, LD: string, IL: string>,
        Method: array<struct<_Name: string, Declaration: string, Implementation: struct<ST: string>>>>,
    DUT: struct<_Name: string, Declaration: string>, GVL: struct<_Name: string, Declaration: string>, Visualization: struct<_Name: string>>"""


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(file, dir, text) of files by name; namespaces are taken off so that elements have plain names."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"\sxmlns(:\w+)?=\"[^\"]*\"|^\ufeff", "")
    return rows.select(F.col("path").alias("file"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), text.alias("text"))


def members(spark: SparkSession, folder: str) -> DataFrame:
    """(file) of all files that a plc project lists, of projects below a system project that a solution names."""
    under = lambda d, p: F.concat_ws("/", d, F.regexp_replace(p, r"\\", "/"))
    named = F.explode(F.regexp_extract_all("text", F.lit(r'Project\("[^"]*"\)\s=\s"[^"]*",\s*"([^"]*\.tsproj)"'), F.lit(1)))
    systems = _files(spark, folder, "*.sln").select("dir", named.alias("p")).select(F.regexp_extract(under("dir", "p"), r"^(.*)/[^/]*$", 1).alias("root"))
    listed = _files(spark, folder, "*.plcproj").select("dir", F.explode(F.regexp_extract_all("text", F.lit(r'\bInclude="([^"]+)"'), F.lit(1))).alias("p"))
    # a folder's ancestors turn "lies below" into an equality
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda i: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), i), "/"))
    below = listed.select("p", "dir", F.explode(up).alias("root")).join(systems.distinct(), "root", "left_semi")
    return below.select(under("dir", "p").alias("file")).distinct()


def read_project(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, name, type, language, declaration, code, methods, file) of a folder's units, types, globals and screens.

    Files that no project lists, and listed files that aren't there, give no rows; text that is no XML gives null fields
    and the file's name as its name. Methods are structs (name, declaration, code, rpc_enabled).
    """
    rows = _files(spark, folder, "*.Tc{POU,DUT,GVL,VIS}").join(members(spark, folder), "file", "left_semi")
    x = rows.select("file", F.from_xml("text", OBJECT, {"mode": "PERMISSIVE"}).alias("x"))
    ending = F.upper(F.regexp_extract("file", r"\.Tc(\w+)$", 1))
    kind = F.when(ending == "VIS", "VISU").otherwise(ending)
    name = F.coalesce("x.POU._Name", "x.DUT._Name", "x.GVL._Name", "x.Visualization._Name", F.regexp_extract("file", r"([^/]*)\.\w+$", 1))
    declaration = F.trim(F.coalesce("x.POU.Declaration", "x.DUT.Declaration", "x.GVL.Declaration"))
    stated = F.lower(F.replace(F.regexp_extract(declaration, r"(?i)^\s*(?:TYPE\s+)?(PROGRAM|FUNCTION_BLOCK|FUNCTION|STRUCT|ENUM|UNION|ALIAS)\b", 1), F.lit("_"), F.lit("")))
    body = F.col("x.POU.Implementation")
    language = F.coalesce(*[F.when(body[n].isNotNull(), n) for n in ("FBD", "ST", "CFC", "SFC", "LD", "IL")])
    methods = F.transform("x.POU.Method", lambda m: F.struct(m["_Name"].alias("name"), F.trim(m["Declaration"]).alias("declaration"), F.trim(m["Implementation"]["ST"]).alias("code"), m["Declaration"].rlike(r"(?i)attribute\s+'TcRpcEnable'").alias("rpc_enabled")))
    return x.select(kind.alias("kind"), name.alias("name"), F.coalesce(F.lower("x.POU._POUType"), F.nullif(stated, F.lit(""))).alias("type"), language.alias("language"), declaration.alias("declaration"), F.trim(F.coalesce(body["ST"], body["FBD"])).alias("code"), methods.alias("methods"), "file")
