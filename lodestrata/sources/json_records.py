"""Game data, schemas, manifests and language files as nodes and edges."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.records import parse_object
from lodestrata.sources.files import classified

BUILDER_VERSION = 12


def first_of(record: dict, *names: str):
    """The first of the names that the record has, whatever their case's first letter."""
    for n in names:
        for key in (n, n[:1].lower() + n[1:], n[:1].upper() + n[1:]):
            if key in record:
                return record[key]
    return None


def text_of(record: dict, label: str, name: str, path: str) -> str:
    """What is embedded for a record: its label and name, all its plain fields in the order they are written, keywords, its file.

    Lists of plain values are joined; one level of inner objects is told as
    ``outer.inner``; ids, names and types aren't told twice.
    """
    lines = [f"{label}: {name}"]
    plain = lambda v: isinstance(v, (str, int, float)) and not isinstance(v, bool) or isinstance(v, bool)
    for key, value in record.items():
        if key.lower() in ("id", "name", "type", "tags"):
            continue
        if plain(value):
            lines.append(f"{key}: {_shown(value)}")
        elif isinstance(value, list) and value and all(map(plain, value)):
            lines.append(f"{key}: " + ", ".join(map(_shown, value)))
        elif isinstance(value, list) and value and all(isinstance(v, dict) for v in value):
            named = [first_of(v, "ItemId", "Id", "Name", "EffectId", "GroupId", "SystemId") for v in value]
            files = [f for v in value for f in (first_of(v, "Files") or []) if isinstance(f, str)]
            told = [str(x) for x in named if isinstance(x, str)] + files
            if told:
                lines.append(f"{key}: " + ", ".join(told))
        elif isinstance(value, dict):
            lines += [f"{key}.{k}: {_shown(v)}" for k, v in value.items() if plain(v)]
    tags = first_of(record, "Tags")
    words = [str(t) for t in tags] if isinstance(tags, list) else [str(x) for kv in tags.items() for x in (kv[1] if isinstance(kv[1], list) else [kv[1]])] if isinstance(tags, dict) else []
    if words:
        lines.append("Keywords: " + ", ".join(words))
    return "\n".join([*lines, f"File: {path}"]).strip()


def _shown(value) -> str:
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


def related_ids(record: dict) -> list[str]:
    """Every ItemId and the like, at any depth, once and in order."""
    found, stack = [], [record]
    while stack:
        value = stack.pop()
        if isinstance(value, dict):
            for k, v in value.items():
                if k in ("ItemId", "ResourceTypeId", "GroupId", "EffectId", "DropList", "NPCGroupId") and isinstance(v, str) and v:
                    found.append(v)
            stack.extend(reversed([v for v in value.values() if isinstance(v, (dict, list))]))
        elif isinstance(value, list):
            stack.extend(reversed([v for v in value if isinstance(v, (dict, list))]))
    return list(dict.fromkeys(found))


def _items(value) -> list[dict]:
    return [v for v in value if isinstance(v, dict)] if isinstance(value, list) else [value] if isinstance(value, dict) else []


def _deep_items(value) -> list[str]:
    """The ItemIds of nested containers."""
    found, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if isinstance(v.get("ItemId"), str):
                found.append(v["ItemId"])
            stack.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            stack.extend(reversed(v))
    return found


def edges_of(data_type: str, record: dict) -> list[tuple[str, str, dict]]:
    """(edge_type, stem or virtual target, metadata) that a record's fields tell; stems are names still to be looked up."""
    out: list[tuple[str, str, dict]] = []

    def bench(source: dict) -> None:
        asked = first_of(source, "BenchRequirement", "station")
        for b in [asked] if isinstance(asked, str) else _items(asked):
            name = b if isinstance(b, str) else first_of(b, "Id")
            if name:
                out.append(("REQUIRES_BENCH", f"virtual:bench:{name}", {}))

    def inputs(source: dict) -> None:
        for i in _items(first_of(source, "Input", "inputs", "ingredients")):
            stem = first_of(i, "ItemId", "item", "Id")
            if isinstance(stem, str):
                out.append(("REQUIRES_ITEM", stem, {}))
            elif isinstance(kind := first_of(i, "ResourceTypeId"), str):
                out.append(("REQUIRES_ITEM", f"virtual:resource:{kind}", {}))

    def outputs(source: dict) -> None:
        for role, names in (("primary", ("PrimaryOutput", "result")), ("secondary", ("Output", "outputs"))):
            for o in _items(first_of(source, *names)):
                if isinstance(stem := first_of(o, "ItemId", "item", "Id"), str):
                    out.append(("PRODUCES_ITEM", stem, {"role": role}))

    def particles(value, trigger: str) -> None:
        for p in value.values() if isinstance(value, dict) and "SystemId" not in value else _items(value) or ([value] if isinstance(value, str) else []):
            name = p if isinstance(p, str) else p.get("SystemId") if isinstance(p, dict) else None
            if name:
                out.append(("SPAWNS_PARTICLE", f"virtual:particle:{name}", {"trigger": trigger}))

    def drops(value) -> None:
        for d in [value] if isinstance(value, str) else value if isinstance(value, list) else _items(value):
            stem = d if isinstance(d, str) else first_of(d, "DropList", "Id", "ItemId") if isinstance(d, dict) else None
            if isinstance(stem, str):
                out.append(("DROPS_ON_DEATH", stem, {}))

    def groups(value) -> None:
        for g in value if isinstance(value, list) else []:
            if isinstance(g, str):
                out.append(("TARGETS_GROUP", g, {}))

    block = record.get("BlockType") if isinstance(record.get("BlockType"), dict) else {}
    recipe = record.get("Recipe") if isinstance(record.get("Recipe"), dict) else None
    if data_type == "item":
        particles(block.get("Particles"), "block_state")
        if recipe:
            bench(recipe)
            inputs(recipe)
    elif data_type == "recipe":
        for source in (record, *([recipe] if recipe else [])):
            bench(source)
            inputs(source)
            outputs(source)
    elif data_type == "drop":
        for stem in _deep_items(record.get("Container")) or _deep_items(first_of(record, "Drops", "entries", "items", "loot")):
            out.append(("DROPS_ITEM", stem, {}))
    elif data_type in ("npc", "entity"):
        for source in (record, record.get("Modify") if isinstance(record.get("Modify"), dict) else {}):
            effects = source.get("ApplicationEffects")
            particles(effects.get("Particles") if isinstance(effects, dict) else None, "applied")
            groups(source.get("TargetGroups"))
        groups(record.get("AcceptedNpcGroups"))
        drops(record.get("DropList"))
        drops(first_of(record, "Drops"))
    elif data_type == "shop":
        for slot in _items(record.get("TradeSlots")):
            for trade in [*_items(slot.get("Trade")), *_items(slot.get("Trades"))]:
                for o in _items(trade.get("Output")):
                    if isinstance(o.get("ItemId"), str):
                        out.append(("OFFERED_IN_SHOP", o["ItemId"], {}))
        for i in first_of(record, "Items") or []:
            stem = i if isinstance(i, str) else first_of(i, "ItemId", "Id") if isinstance(i, dict) else None
            if isinstance(stem, str):
                out.append(("OFFERED_IN_SHOP", stem, {}))
    elif data_type == "npc_group":
        for m in first_of(record, "Members", "NPCs") or []:
            stem = m if isinstance(m, str) else first_of(m, "NPC", "Id") if isinstance(m, dict) else None
            if isinstance(stem, str):
                out.append(("HAS_MEMBER", stem, {}))
    elif data_type == "objective":
        for s in _items(record.get("TaskSets")):
            for t in _items(s.get("Tasks")):
                if isinstance(g := first_of(t, "NPCGroupId", "GroupId"), str):
                    out.append(("TARGETS_GROUP", g, {}))
    elif data_type == "block":
        for event, value in (record.get("Particles") or {}).items() if isinstance(record.get("Particles"), dict) else ():
            particles({"SystemId": value} if isinstance(value, str) else value, event)
        drops(first_of(record, "Drops", "lootTable"))
    elif data_type == "farming":
        groups(record.get("AcceptedNpcGroups"))
    elif data_type in ("projectile", "weather"):
        for key, trigger in (("HitParticles", "hit"), ("DeathParticles", "death"), ("Particle", "ambient")):
            particles(record.get(key), trigger)
    elif data_type == "interaction":
        for e in _items(first_of(record, "Effects")):
            if isinstance(e.get("EffectId"), str):
                out.append(("APPLIES_EFFECT", f"virtual:effect:{e['EffectId']}", {}))
        if "Effect" in str(record.get("Action", "")) and isinstance(record.get("EffectId"), str):
            out.append(("APPLIES_EFFECT", f"virtual:effect:{record['EffectId']}", {}))
    elif data_type == "zone":
        mask = record.get("NoiseMask")
        if isinstance(mask, dict) and isinstance(mask.get("File"), str):
            out.append(("REFERENCES_WORLDGEN", f"virtual:worldgen:{mask['File']}", {}))
    elif data_type == "plugin_manifest":
        for key, extra in (("Dependencies", {}), ("OptionalDependencies", {"optional": True})):
            for name in record.get(key) or {}:
                out.append(("DEPENDS_ON", f"gamedata:manifest:{name.rsplit(':', 1)[-1]}", extra))
    return list({(a, b): (a, b, c) for a, b, c in reversed(out)}.values())[::-1]


NODE_SCHEMA = "path string, id string, display_name string, data_type string, content string, embedding_text string, related array<string>, edges array<struct<edge_type:string,target:string,metadata:string>>, error string"


def game_nodes(files: DataFrame) -> DataFrame:
    """One node a file: its text, the ids it refers to and its edges, with ``error`` for what can't be parsed.

    The JSON is kept whole; repeated ids are told apart later (see ``numbered_ids``).
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("id", pa.string()), ("display_name", pa.string()), ("data_type", pa.string()), ("content", pa.string()), ("embedding_text", pa.string()), ("related", pa.list_(pa.string())), ("edges", pa.list_(pa.struct([("edge_type", pa.string()), ("target", pa.string()), ("metadata", pa.string())]))), ("error", pa.string())])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                record = parse_object(r["content"])
                if record is None:
                    rows.append({**r, "embedding_text": None, "related": [], "edges": [], "error": "no JSON object"})
                    continue
                named = first_of(record, "Name", "Id")
                name = named if isinstance(named, str) and named.strip() else r["display_name"]
                label = r["data_type"].replace("_", " ").capitalize()
                edges = [{"edge_type": a, "target": b, "metadata": json.dumps(c) if c else None} for a, b, c in edges_of(r["data_type"], record)]
                rows.append({**r, "display_name": name, "embedding_text": text_of(record, label, name, r["path"]), "related": related_ids(record), "edges": edges, "error": None})
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return classified(files).select("path", "id", "display_name", "data_type", "content").mapInArrow(walk, NODE_SCHEMA)


def game_edges(nodes: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_type, target_resolved, metadata): stems looked up by name without case, each match an edge.

    A stem of several nodes is marked ``multi_match``; one of none stays as it
    is, unresolved, as do virtual targets. A node isn't its own target.
    """
    e = nodes.select(F.col("id").alias("source_id"), F.explode("edges").alias("e")).select("source_id", "e.edge_type", F.col("e.target").alias("stem"), "e.metadata")
    names = nodes.select(F.lower("display_name").alias("key"), F.col("id").alias("target_id")).unionByName(nodes.select(F.lower(F.substring_index("id", ":", -1)).alias("key"), F.col("id").alias("target_id"))).distinct()
    named = e.filter(~F.col("stem").startswith("virtual:") & ~F.col("stem").startswith("gamedata:"))
    hits = named.join(names, F.lower("stem") == F.col("key"), "left").filter(F.col("target_id").isNull() | (F.col("target_id") != F.col("source_id")))
    sized = hits.groupBy("source_id", "edge_type", "stem", "metadata").agg(F.collect_set("target_id").alias("targets"))
    resolved = sized.select("source_id", F.explode_outer("targets").alias("target_id"), "edge_type", "stem", F.when(F.size("targets") > 1, F.lit('{"multi_match": true}')).otherwise(F.col("metadata")).alias("metadata"))
    found = resolved.select("source_id", F.coalesce("target_id", "stem").alias("target_id"), "edge_type", F.col("target_id").isNotNull().cast("int").alias("target_resolved"), "metadata")
    fixed = e.filter(F.col("stem").startswith("virtual:") | F.col("stem").startswith("gamedata:")).join(nodes.select(F.col("id").alias("stem"), F.lit(1).alias("known")).distinct(), "stem", "left")
    return found.unionByName(fixed.select("source_id", F.col("stem").alias("target_id"), "edge_type", F.coalesce("known", F.lit(0)).alias("target_resolved"), "metadata")).dropDuplicates(["source_id", "target_id", "edge_type"])


def parse_schema(path: str, text: str) -> list[dict]:
    """The nodes of a schema file: one a definition, or one for a titled schema; else none."""
    root = parse_object(text)
    if root is None:
        return []
    if isinstance(root.get("definitions"), dict):
        return [{"id": f"gamedata:schema:def:{n}", "display_name": n, "data_type": "schema", "path": path, "content": json.dumps(d, ensure_ascii=False)} for n, d in root["definitions"].items()]
    if isinstance(root.get("title"), str):
        return [{"id": f"gamedata:schema:{root['title']}", "display_name": root["title"], "data_type": "schema", "path": path, "content": text}]
    return []


def parse_manifest(path: str, text: str) -> dict | None:
    """The node of a plugin's manifest; it needs a name."""
    root = parse_object(text)
    name = first_of(root, "Name") if root else None
    if not isinstance(name, str) or not name.strip():
        return None
    return {"id": f"gamedata:manifest:{name}", "display_name": name, "data_type": "plugin_manifest", "path": path, "content": text}


def parse_language(text: str) -> dict[str, str]:
    """Keys and values of a language file: ``key = value`` lines, # comments, a backslash at a line's end joining it with the next."""
    out, carried = {}, ""
    for line in text.removeprefix("\ufeff").splitlines():
        line = carried + (line.lstrip() if carried else line)
        carried = ""
        if line.endswith("\\"):
            carried = line[:-1]
            continue
        if line.strip() and not line.lstrip().startswith("#") and "=" in line:
            key, value = line.split("=", 1)
            out[key.strip()] = value.strip()
    return out


def language_prefix(path: str) -> str:
    """The prefix of a file's keys: its folders below the language, and its name, joined by dots."""
    parts = path.replace("\\", "/").split("/")
    if "Languages" in parts:
        parts = parts[parts.index("Languages") + 2 :]
    return ".".join(parts).rsplit(".", 1)[0] if parts else ""


def language_groups(keys: list[str], most: int = 50) -> dict[str, list[str]]:
    """Keys by their first part; few keys or one part stay together under ''."""
    groups: dict[str, list[str]] = {}
    for k in keys:
        groups.setdefault(k.split(".", 1)[0], []).append(k)
    return {"": list(keys)} if len(keys) <= most or len(groups) <= 1 else groups


def block_palette(record: dict, top: int = 15) -> dict:
    """Of a prefab's blocks: the most frequent names with their counts, and the box that holds them."""
    blocks = [b for b in first_of(record, "Blocks") or [] if isinstance(b, dict)]
    count: dict[str, int] = {}
    for b in blocks:
        name = first_of(b, "Name", "Block", "Id")
        if isinstance(name, str):
            count[name] = count.get(name, 0) + 1
    box = {a: (min(v), max(v)) for a in "xyz" if (v := [b[a] for b in blocks if isinstance(b.get(a), (int, float))])}
    return {"palette": sorted(count.items(), key=lambda kv: (-kv[1], kv[0]))[:top], "box": box, "n": len(blocks)}


def implemented_by(records: DataFrame, classes: DataFrame, mapping: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_type): records bound to the classes that handle their type.

    ``records`` has (id, data_type), ``classes`` (id, display_name), ``mapping``
    (data_type, class_name), a table of the game's own that comes with its data.
    """
    named = mapping.join(classes.select(F.col("id").alias("target_id"), F.col("display_name").alias("class_name")), "class_name").select("data_type", "target_id").distinct()
    return records.select(F.col("id").alias("source_id"), "data_type").distinct().join(named, "data_type").select("source_id", "target_id", F.lit("IMPLEMENTED_BY").alias("edge_type"))


def translations(files: DataFrame) -> DataFrame:
    """(key, value) of language files, keys with their file's prefix; of a key in several files the least path's holds, fallback files are left out."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("key", pa.string()), ("path", pa.string()), ("value", pa.string())])
        for batch in batches:
            rows = [{"key": ".".join(x for x in (language_prefix(p), k) if x), "path": p, "value": v} for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, v in parse_language(t or "").items()]
            yield pa.RecordBatch.from_pylist(rows, kinds)

    made = files.filter(F.col("path").endswith(".lang") & ~F.col("path").endswith("fallback.lang")).select("path", "content").mapInArrow(walk, "key string, path string, value string")
    return made.groupBy("key").agg(F.min_by("value", "path").alias("value"))


def translated(records: DataFrame, words: DataFrame, key: str, into: str) -> DataFrame:
    """``records`` with the translation of the key in column ``key`` as ``into``; null without one."""
    return records.join(words.select(F.col("key").alias("__key"), F.col("value").alias(into)), F.col(key) == F.col("__key"), "left").drop("__key")
