"""Java source as nodes and edges, by a tolerant scanner of braces.

There is no compiler here: types are resolved by their simple names, calls by
the class named before the dot, which is less than a symbol solver finds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(r'/\*.*?(?:\*/|\Z)|//[^\n]*|""".*?(?:"""|\Z)|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'', re.S)
_TYPE = re.compile(r"\b(class|interface|enum|record|@interface)\s+([A-Za-z_]\w*)")
_METHOD = re.compile(r"([A-Za-z_]\w*)\s*\(")
_CONTROL = frozenset("if for while switch catch synchronized return throw new else do try super this assert yield".split())
_VISIBILITY = re.compile(r"\b(public|protected|private)\b")
_ANNOTATION = re.compile(r"@([A-Za-z_][\w.]*)")
_CALL = re.compile(r"(?:\b([A-Za-z_]\w*)\s*\.\s*)?([a-z_]\w*)\s*\(")
_INSTANCE = re.compile(r"\binstanceof\s+(?:final\s+)?([A-Z]\w*)")


def blanked(text: str) -> str:
    """The text with comments and literals blanked out, every character in its place."""
    return _TOKEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def split_commas(text: str) -> list[str]:
    """Parts between commas that stand in no brackets."""
    out, depth, part = [], 0, []
    for c in text:
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and depth == 0:
            out.append("".join(part).strip())
            part = []
        else:
            part.append(c)
    return [p for p in [*out, "".join(part).strip()] if p]


def parameter_type(parameter: str) -> str:
    """The type of one parameter, without annotations, modifiers, type arguments and name."""
    bare = re.sub(r"@\w+(?:\([^)]*\))?|\bfinal\b", " ", parameter)
    while re.search(r"<[^<>]*>", bare):
        bare = re.sub(r"<[^<>]*>", "", bare)
    words = bare.replace("...", "[] ").split()
    return (words[0] if len(words) < 2 else "".join(words[:-1])) if words else ""


def parameter_types(signature: str) -> list[str]:
    m = re.search(r"\((.*)\)", signature, re.S)
    return [parameter_type(p) for p in split_commas(m[1])] if m else []


def _match(code: str, at: int, opens: str, closes: str) -> int:
    depth = 0
    for k in range(at, len(code)):
        if code[k] == opens:
            depth += 1
        elif code[k] == closes:
            depth -= 1
            if not depth:
                return k
    return len(code) - 1


def _supers(head: str) -> dict[str, list[str]]:
    found = {}
    for word, edge in (("extends", "EXTENDS"), ("implements", "IMPLEMENTS"), ("permits", "PERMITS")):
        m = re.search(rf"\b{word}\b(.*?)(?=\bextends\b|\bimplements\b|\bpermits\b|$)", head, re.S)
        if m:
            found[edge] = [re.sub(r"<.*", "", p, flags=re.S).strip() for p in split_commas(m[1])]
    return found


def parse(text: str) -> dict:
    """package, types and methods of a file; what can't be read is skipped."""
    code = blanked(text)
    package = (m := re.search(r"\bpackage\s+([\w.]+)\s*;", code)) and m[1] or ""
    types: list[dict] = []
    for m in _TYPE.finditer(code):
        start = code.find("{", m.end())
        if start < 0:
            continue
        head = code[m.end() : start]
        if ";" in head:
            continue
        types.append({"kind": m[1], "name": m[2], "at": m.start(), "open": start, "end": _match(code, start, "{", "}"), "head": re.sub(r"\(.*?\)", "", head, flags=re.S) if m[1] == "record" else head})
    for t in types:
        around = [o for o in types if o["open"] < t["at"] and o["end"] >= t["end"] and o is not t]
        t["full"] = ".".join([*([package] if package else []), *(o["name"] for o in sorted(around, key=lambda o: o["open"])), t["name"]])
        t["supers"] = _supers(t["head"])
    methods: list[dict] = []
    for t in types:
        inner = [o for o in types if t["open"] < o["at"] and o["end"] <= t["end"]]
        at, last = t["open"] + 1, t["open"] + 1
        while at < t["end"]:
            nested = next((o for o in inner if o["at"] <= at <= o["end"]), None)
            if nested:
                at = last = nested["end"] + 1
                continue
            c = code[at]
            if c == ";":
                _method(text, code, t, last, at, None, methods)
                last = at + 1
            elif c == "{":
                close = _match(code, at, "{", "}")
                _method(text, code, t, last, at, close, methods)
                at = close
                last = at + 1
            elif c == "(":
                at = _match(code, at, "(", ")")
            at += 1
    return {"package": package, "types": types, "methods": methods}


def _method(text: str, code: str, owner: dict, start: int, end: int, close: int | None, out: list[dict]) -> None:
    head = code[start:end]
    m = next((x for x in _METHOD.finditer(head) if x[1] not in _CONTROL and not re.search(r"@\s*[\w.]*$", head[: x.start()]) and not re.search(r"\bnew\s+$|[.=]\s*$", head[: x.start()])), None)
    if m is None or "=" in head[: m.start()]:
        return
    first = start + len(head) - len(head.lstrip())
    raw = text[start : (close if close is not None else end) + 1]
    lead = len(raw) - len(raw.lstrip())
    body = code[end + 1 : close] if close is not None else ""
    signature = re.sub(r"\s+", " ", text[first:end]).strip()
    statements = [s for s in re.split(r"[;{}]", body) if s.strip()]
    v = _VISIBILITY.search(head)
    parameters = code[first:end]
    out.append({
        "owner": owner["full"], "name": m[1], "line_start": text.count("\n", 0, start + lead) + 1, "line_end": text.count("\n", 0, close if close is not None else end) + 1, "content": raw.strip(), "signature": signature,
        "types": parameter_types(parameters[parameters.find(m[1] + "(") :] if m[1] + "(" in parameters else parameters), "visibility": v[1] if v else "package", "annotations": [a for a in _ANNOTATION.findall(head) if a != "interface"],
        "thin": close is not None and len(statements) == 1 and bool(re.match(r"\s*(?:return\s+)?[\w.]+\([^;]*\)\s*$", statements[0])), "calls": list(dict.fromkeys((a or "", b) for a, b in _CALL.findall(body) if b not in _CONTROL)), "instanceof": list(dict.fromkeys(_INSTANCE.findall(body))),
    })


NODES = "id string, node_type string, display_name string, path string, line_start int, line_end int, content string, embedding_text string, metadata string, edges array<struct<edge_type:string,target:string>>"


def java_nodes(files: DataFrame, most: int = 8000) -> DataFrame:
    """Packages, classes and methods of Java files, with the edges their source tells by simple names.

    ``files`` has (path, content). Overloads are ``name~2`` and so on in order
    of the source.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(n, pa.string()) for n in ("id", "node_type", "display_name", "path")] + [("line_start", pa.int32()), ("line_end", pa.int32())] + [(n, pa.string()) for n in ("content", "embedding_text", "metadata")] + [("edges", pa.list_(pa.struct([("edge_type", pa.string()), ("target", pa.string())])))])
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += _rows(path, text or "", most)
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return files.select("path", "content").mapInArrow(walk, NODES)


def _rows(path: str, text: str, most: int) -> list[dict]:
    parsed, rows = parse(text), []
    base = {"path": path, "line_start": None, "line_end": None, "content": None, "embedding_text": None, "metadata": None}
    if parsed["package"]:
        rows.append({**base, "id": f"pkg:{parsed['package']}", "node_type": "Package", "display_name": parsed["package"], "path": None, "edges": [{"edge_type": "CONTAINS", "target": f"class:{t['full']}"} for t in parsed["types"]]})
    for t in parsed["types"]:
        edges = [{"edge_type": e, "target": n} for e, names in t["supers"].items() for n in names]
        rows.append({**base, "id": f"class:{t['full']}", "node_type": "JavaClass", "display_name": t["name"], "line_start": text.count("\n", 0, t["at"]) + 1, "line_end": text.count("\n", 0, t["end"]) + 1, "edges": edges})
    seen: dict[str, int] = {}
    for m in parsed["methods"]:
        key = f"{m['owner']}#{m['name']}"
        seen[key] = seen.get(key, 0) + 1
        simple = m["owner"].rsplit(".", 1)[-1]
        edges = [{"edge_type": "DECLARED_IN", "target": f"class:{m['owner']}"}, *({"edge_type": "CALLS", "target": f"{a}#{b}" if a[:1].isupper() else f"{simple}#{b}"} for a, b in m["calls"] if not a or a == "this" or a[:1].isupper()), *({"edge_type": "INSTANCEOF", "target": n} for n in m["instanceof"])]
        told = "\n".join([f"// Package: {parsed['package']}", f"// Class: {simple}", f"// Method: {m['name']}", m["content"]])
        rows.append({**base, "id": key + (f"~{seen[key]}" if seen[key] > 1 else ""), "node_type": "JavaMethod", "display_name": f"{simple}#{m['name']}", "line_start": m["line_start"], "line_end": m["line_end"], "content": m["content"], "embedding_text": told[:most], "metadata": json.dumps({"visibility": m["visibility"], "annotations": [{"name": a} for a in m["annotations"]], "thin": m["thin"], "params": [{"type": {"base": x}} for x in m["types"]]}), "edges": edges})
    return rows


def java_edges(nodes: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_type, target_resolved): simple names resolved to the class of that name (the least full name), over all nodes; what isn't known stays unresolved."""
    e = nodes.select(F.col("id").alias("source_id"), F.explode("edges").alias("e")).select("source_id", "e.edge_type", F.col("e.target").alias("name"))
    by = Window.partitionBy("simple").orderBy("class_id")
    classes = nodes.filter("node_type = 'JavaClass'").select(F.col("id").alias("class_id"), F.col("display_name").alias("simple")).distinct().withColumn("n", F.row_number().over(by)).filter("n = 1").drop("n")
    simple = F.when(F.col("name").startswith("class:"), F.lit(None)).otherwise(F.substring_index(F.substring_index("name", "#", 1), ".", -1))
    joined = e.withColumn("simple", simple).join(classes, "simple", "left")
    method = F.when(F.instr("name", "#") > 0, F.concat(F.regexp_replace("class_id", "^class:", ""), F.lit("#"), F.substring_index("name", "#", -1)))
    found = joined.select("source_id", "edge_type", F.when(F.col("name").startswith("class:"), F.col("name")).when(F.col("class_id").isNull(), F.concat(F.lit("class:"), "simple")).otherwise(F.coalesce(method, "class_id")).alias("target_id"), F.when(F.instr("name", "#") > 0, F.col("class_id")).alias("fallback"))
    known = nodes.select(F.col("id").alias("target_id"), F.lit(1).alias("known")).distinct()
    out = found.join(known, "target_id", "left")
    target = F.when((F.col("edge_type") == "CALLS") & F.col("known").isNull() & F.col("fallback").isNotNull(), F.col("fallback")).otherwise(F.col("target_id"))
    resolved = F.when(F.col("known").isNotNull() | (target == F.col("fallback")), 1).otherwise(0)
    return out.select("source_id", target.alias("target_id"), "edge_type", F.coalesce(resolved, F.lit(0)).alias("target_resolved")).filter("target_id <> source_id").dropDuplicates(["source_id", "target_id", "edge_type"])
