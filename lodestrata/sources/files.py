"""Source trees as DataFrames of files, and where each file belongs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import basename, source_path

#: Patterns of paths and the data type they stand for, in order of precedence.
PATH_TYPES = (
    (r"Server/Item/(Items|Groups|Category|ResourceTypes|Qualities)", "item"), (r"Server/Item/Recipes", "recipe"), (r"Server/(Item/Block|BlockTypeList)", "block"), (r"Server/(Item/Interactions|Item/RootInteractions|Item/Unarmed|TriggerVolumes)", "interaction"),
    (r"Server/Drops", "drop"), (r"Server/NPC/(Roles|Flocks|Attitude)", "npc"), (r"Server/NPC/Groups", "npc_group"), (r"Server/NPC/(DecisionMaking|Balancing)", "npc_ai"), (r"Server/Entity", "entity"), (r"Server/Projectiles", "projectile"),
    (r"Server/Farming", "farming"), (r"Server/BarterShops", "shop"), (r"Server/Environments", "environment"), (r"Server/Weathers", "weather"), (r"Server/Camera", "camera"), (r"Server/Objective", "objective"), (r"Server/GameplayConfigs", "gameplay"),
    (r"Server/[A-Za-z]+Generator/Biomes", "biome"), (r"Server/[A-Za-z]+Generator/", "worldgen"), (r"Server/Audio", "audio"), (r"Server/NPC/Spawn", "npc_spawn"), (r"Server/ProjectileConfigs", "projectile_config"), (r"Server/Models", "model"),
    (r"Server/Item/Animations", "animation"), (r"Server/Instances", "instance"), (r"Server/ScriptedBrushes", "scripted_brush"), (r"Server/MacroCommands", "macro_command"), (r"Server/TagPatterns", "tag_pattern"), (r"Server/ResponseCurves", "response_curve"),
    (r"Server/PortalTypes", "portal"), (r"Server/Particles", "particle"), (r"Server/EncounterManager", "encounter"), (r"Server/(PrefabList|Prefabs)", "prefab"), (r"(Server/WordLists|Common/Languages)", "localization"),
    (r"Server/World/(.+/)?Zones/(.+/)?Layers", "terrain_layer"), (r"Server/World/.+/Zones/.+/Cave", "cave"), (r"Server/World/(.+/)?Zones/Masks", "zone"), (r"Server/World/(.+/)?Zones/Noise", "worldgen"), (r"Server/World/(.+/)?Zones", "zone"),
)
#: Parts of paths that are no content.
IGNORED = r"(?i)(^|/)(\.git|\.idea|node_modules|__MACOSX|build|cache)(/|$)"


def data_type(path: Column) -> Column:
    """The first pattern's type; misc for anything else of the server; else null."""
    return F.coalesce(*(F.when(path.rlike(p), t) for p, t in PATH_TYPES), F.when(F.contains(path, F.lit("Server/")), "misc"))


def is_ignored(path: Column) -> Column:
    return path.rlike(IGNORED)


def read_tree(spark: SparkSession, roots: list[str], glob: str = "*", strip: bool = True) -> DataFrame:
    """(path, root, content, file_hash): the files of source trees, as text of any line ends, with the SHA-256 of their bytes.

    Paths are relative to their root; unreadable files are left out.
    """
    parts = []
    for root in roots:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("ignoreCorruptFiles", True).load(root)
        bare = root.rstrip("/").removeprefix("file:")
        relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^\\Q" + bare + "\\E/*", "")
        parts.append(raw.select((source_path(relative) if strip else relative).alias("path"), F.lit(root).alias("root"), F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "").alias("content"), F.sha2("content", 256).alias("file_hash")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(~is_ignored(F.col("path")))


def read_archives(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(path, root, content, file_hash) of the entries of zip archives, each archive read by one task."""
    import hashlib
    import io
    import zipfile
    from collections.abc import Iterator

    import pyarrow as pa

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for entry in z.infolist():
                        if not entry.is_dir() and entry.filename.endswith(suffix):
                            body = z.read(entry)
                            yield pa.RecordBatch.from_pylist([{"path": entry.filename, "root": name, "content": body.decode("utf-8", "replace").removeprefix("\ufeff"), "file_hash": hashlib.sha256(body).hexdigest()}])

    return raw.mapInArrow(walk, "path string, root string, content string, file_hash string").filter(~is_ignored(F.col("path")))


def classified(files: DataFrame) -> DataFrame:
    """Files with data_type, id and display_name; those of no type are left out."""
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    return files.withColumn("data_type", data_type(F.col("path"))).filter("data_type is not null").withColumns({"id": F.concat(F.lit("gamedata:"), F.translate(bare, "/", ":")), "display_name": basename(bare)})
