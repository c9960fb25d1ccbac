"""The song catalog: declared schema, file-name parsing, merging with a prior catalog, ids and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

#: name, Spark type, allowed values.
SCHEMA = [
    ("song_id", "int", None), ("title", "string", None), ("artist", "string", None), ("repertoire", "string", ("american", "opm")), ("role", "string", ("db", "holdout")), ("split", "string", ("dev", "test")),
    ("year", "int", None), ("source_path", "string", None), ("proc_path", "string", None), ("duration_sec", "double", None), ("sha256", "string", None),
]


def coerce(raw: DataFrame, schema=SCHEMA) -> DataFrame:
    """All-string columns to their declared types: missing text is '', a missing integer 0, a value outside its domain null; undeclared columns follow."""
    missing = [n for n, _, _ in schema if n not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = []
    for name, kind, levels in schema:
        c = F.col(name)
        if kind == "string":
            c = F.coalesce(c, F.lit(""))
            c = F.when(c.isin(*levels), c) if levels else c
        else:
            c = c.try_cast("double")
            c = F.coalesce(c, F.lit(0.0)).cast("int") if kind == "int" else c
        out.append(c.alias(name))
    return raw.select(*out, *[c for c in raw.columns if c not in {n for n, _, _ in schema}])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1")


def parse_file_name(name: Column) -> dict[str, Column]:
    """artist, title and year of a file name without folder: a punctuated leading track number goes, a year in brackets is taken out, ` - ` parts artist and title."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    stem = F.regexp_replace(stem, r"^\s*\d{1,3}\s*[.\-_)]+\s*", "")
    year = F.regexp_extract(stem, r"[(\[]((?:19|20)\d{2})[)\]]", 1)
    rest = F.btrim(F.regexp_replace(stem, r"\s*[(\[](?:19|20)\d{2}[)\]]\s*", " "), F.lit(" "))
    at = F.instr(rest, " - ")
    artist = F.when(at > 0, F.btrim(F.substr(rest, F.lit(1), at - F.lit(1)))).otherwise(F.lit(""))
    title = F.when(at > 0, F.btrim(F.substr(rest, at + F.lit(3)))).otherwise(rest)
    return {"artist": F.coalesce(F.nullif(artist, F.lit("")), F.lit("unknown")), "title": F.coalesce(F.nullif(title, F.lit("")), F.lit("untitled")), "year": F.coalesce(year.try_cast("int"), F.lit(0))}


#: File extensions of a library scan (fixed values).
AUDIO = ("wav", "flac", "mp3", "m4a", "mp4", "aac", "ogg", "wma", "aif", "aiff", "au", "opus")


def path_kinds(paths: DataFrame, column: str = "path") -> DataFrame:
    """Adds repertoire (opm before american) and role, from the folders of a path, and skipped: why a scan leaves it out (hidden, no audio, no repertoire), else null."""
    parts = F.split(F.lower(F.col(column)), "[/\\\\]")
    name = F.element_at(parts, -1)
    out = paths.withColumn("repertoire", F.when(F.array_contains(parts, "opm"), "opm").when(F.array_contains(parts, "american"), "american")).withColumn("role", F.when(F.array_contains(parts, "holdout"), "holdout").otherwise("db"))
    why = F.when(F.startswith(name, F.lit(".")), "hidden").when(~F.regexp_extract(name, r"\.([^.]+)$", 1).isin(*AUDIO), "no audio").when(F.col("repertoire").isNull(), "no repertoire")
    return out.withColumn("skipped", why)


def classify_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    """Audio files of a scan with repertoire (opm before american; rows of neither are left out) and role, from their folders; dot files are skipped."""
    return path_kinds(paths, column).where("skipped is null").drop("skipped")


def classify_observed(paths: DataFrame, column: str = "path") -> tuple[DataFrame, Observation]:
    """classify_paths(), and what it left out: n_files, n_hidden, n_no_audio, n_no_repertoire, known once the rows have been read, from the same pass."""
    seen = Observation()
    number = lambda why: F.count(F.when(F.col("skipped") == why, 1)).alias("n_" + why.replace(" ", "_"))
    rows = path_kinds(paths, column).observe(seen, F.count(F.lit(1)).alias("n_files"), *map(number, ("hidden", "no audio", "no repertoire")))
    return rows.where("skipped is null").drop("skipped"), seen


def merge_prior(scan: DataFrame, prior: DataFrame) -> DataFrame:
    """Scanned files with what a prior catalog knows of the same source_path: folders decide role and repertoire, prior text and ids win where not empty."""
    p = prior.select("source_path", *[F.col(c).alias(f"p_{c}") for c in ("song_id", "title", "artist", "year", "split", "duration_sec", "sha256")])
    j = scan.join(p, "source_path", "left")
    keep = lambda c: F.coalesce(F.nullif(F.col(f"p_{c}"), F.lit("")), F.col(c)).alias(c)
    return j.select("source_path", "repertoire", "role", keep("title"), keep("artist"), F.coalesce(F.nullif("p_year", F.lit(0)), F.col("year")).alias("year"), F.col("p_song_id").alias("song_id"), F.col("p_split").alias("split"), F.col("p_duration_sec").alias("duration_sec"), F.coalesce("p_sha256", F.lit("")).alias("sha256"))


def retired(scan: DataFrame, prior: DataFrame) -> DataFrame:
    return prior.join(scan, "source_path", "left_anti")


def assign_ids(rows: DataFrame, highest: int = 0) -> DataFrame:
    """Gives new rows (song_id null) the ids after the highest ever used, in order of path; old ids stay and retired ones, whose highest the caller knows, are never used again."""
    top = rows.agg(F.greatest(F.coalesce(F.max("song_id"), F.lit(0)), F.lit(highest)).alias("__top"))
    new = rows.where("song_id is null").withColumn("__k", F.row_number().over(Window.orderBy("source_path"))).join(F.broadcast(top), F.lit(True))
    new = new.withColumn("song_id", (F.col("__top") + F.col("__k")).cast("int")).drop("__k", "__top")
    return rows.where("song_id is not null").unionByName(new)


def assign_splits(rows: DataFrame, seed: int, dev_db: float = 0.20, dev_holdout: float = 0.5) -> DataFrame:
    """Fills missing splits by stratum (role, repertoire): assigned ones stay, the shortfall of dev songs is drawn by seed, the rest is test."""
    stratum = Window.partitionBy("role", "repertoire")
    want = F.round(F.count("*").over(stratum) * F.when(F.col("role") == "holdout", dev_holdout).otherwise(dev_db)).cast("int")
    have = F.count(F.when(F.col("split") == "dev", 1)).over(stratum)
    out = rows.withColumn("__need", F.greatest(want - have, F.lit(0))).withColumn("__open", F.coalesce(F.col("split"), F.lit("")) == "")
    luck = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("source_path")).cast("binary"))
    out = out.withColumn("__k", F.row_number().over(Window.partitionBy("role", "repertoire", "__open").orderBy(luck, "source_path")))
    return out.withColumn("split", F.when(~F.col("__open"), F.col("split")).when(F.col("__k") <= F.col("__need"), "dev").otherwise("test")).drop("__need", "__open", "__k")


def resolve_path(root: str, path: Column) -> Column:
    """A catalog-relative path under a root, with forward slashes."""
    p = F.translate(path, "\\", "/")
    return F.when(p == "", "").when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))


def work_list(files: DataFrame, done: DataFrame, slack_sec: int = 1) -> DataFrame:
    """Files whose output is missing, unfinished or older than the source: those without a done row of 64-digit checksum, positive duration and a time not before the source's."""
    d = done.where((F.length("sha256") == 64) & (F.col("duration_sec") > 0)).select("source_path", F.col("modified").alias("__m"))
    fresh = (files["source_path"] == d["source_path"]) & (F.unix_timestamp(files["modified"]) <= F.unix_timestamp(d["__m"]) + slack_sec)
    return files.join(d, fresh, "left_anti")


def missing_noise(bank: DataFrame, wanted: DataFrame) -> DataFrame:
    """Noise types that a bank lacks."""
    return wanted.join(bank, "noise_type", "left_anti")


def channel_one(files: DataFrame, code: str) -> DataFrame:
    """The channel-01 recording of a code: the only one, or the only one in a 16k folder; an error if there is none or several remain."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    c = files.where(F.contains(F.lower("path"), F.lit(code.lower())) & F.contains(name, F.lit("ch01"))).withColumn("k16", F.contains(F.lower("path"), F.lit("16k")))
    one = c.agg(F.count("*").alias("n"), F.count(F.when(F.col("k16"), 1)).alias("n16"), F.min("path").alias("any"), F.min(F.when(F.col("k16"), F.col("path"))).alias("own"))
    wrong = lambda why: F.raise_error(F.lit(f"channel 01 of {code} {why}"))
    path = F.when(F.col("n") == 1, F.col("any")).when(F.col("n16") == 1, F.col("own")).when(F.col("n") == 0, wrong("is not there")).otherwise(wrong("is not unique"))
    return one.select(path.cast("string").alias("path"))


def composition(rows: DataFrame) -> DataFrame:
    """Counts by (repertoire, role, split), by repertoire and in total, from one pass of grouping sets."""
    c = [F.col(x) for x in ("repertoire", "role", "split")]
    return rows.groupingSets([c, c[:1], []], *c).agg(F.grouping_id(*c).alias("level"), F.count("*").alias("n"))
