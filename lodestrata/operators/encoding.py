"""Results as text: a compact tabular notation, JSON, Markdown reports."""

from __future__ import annotations

import json
import re

_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$")
_SPECIAL = re.compile(r'[,:"\\\[\]{}\x00-\x1f\x7f]')


def quoted(value) -> str:
    """A scalar of the compact notation; text is quoted only where it could be read as something else."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return json.dumps(value)
    text = str(value)
    plain = text and text == text.strip() and text not in ("true", "false", "null") and not text.startswith("-") and not _NUMBER.match(text) and not re.match(r"0\d+$", text) and not _SPECIAL.search(text)
    return text if plain else json.dumps(text, ensure_ascii=False)


def _flat(value) -> bool:
    return value is None or isinstance(value, (str, int, float, bool))


def to_compact(value: dict, indent: int = 0) -> str | None:
    """A JSON object in the compact notation; None where it doesn't apply (mixed or nested rows, a list at the top)."""
    if not isinstance(value, dict):
        return None
    lines, pad = [], "  " * indent
    for key, v in value.items():
        if _flat(v):
            lines.append(f"{pad}{key}: {quoted(v)}")
        elif isinstance(v, dict):
            inner = to_compact(v, indent + 1)
            if inner is None:
                return None
            lines.append(f"{pad}{key}:" + (f"\n{inner}" if inner else ""))
        elif not v:
            lines.append(f"{pad}{key}: []")
        elif all(map(_flat, v)):
            lines.append(f"{pad}{key}[{len(v)}]: " + ",".join(map(quoted, v)))
        else:
            fields = list(v[0]) if isinstance(v[0], dict) else None
            if not fields or any(not isinstance(r, dict) or list(r) != fields or not all(map(_flat, r.values())) for r in v):
                return None
            lines.append(f"{pad}{key}[{len(v)}]{{{','.join(fields)}}}:")
            lines += [f"{pad}  " + ",".join(quoted(r[f]) for f in fields) for r in v]
    return "\n".join(lines)


def encode(value) -> str:
    """The compact notation where it applies, else JSON."""
    compact = to_compact(value)
    return compact if compact is not None else json.dumps(value, ensure_ascii=False)


def diff_markdown(entries: list[dict], title: str) -> str:
    """A report of differences: counts by corpus, then entries by weight, then name."""
    lines = [f"# {title}", ""]
    corpora = sorted({e["corpus"] for e in entries})
    lines += ["| corpus | added | removed | changed |", "|---|---|---|---|"]
    lines += [f"| {c} | " + " | ".join(str(sum(e["corpus"] == c and e["change"] == k for e in entries)) for k in ("ADDED", "REMOVED", "CHANGED")) + " |" for c in corpora]
    for weight in ("HIGH", "MEDIUM", "LOW"):
        mine = sorted((e for e in entries if e["significance"] == weight), key=lambda e: (e.get("display_name") or "", e["id"]))
        if mine:
            lines += ["", f"## {weight}", *(f"- {e['change']} {e.get('display_name') or e['id']} ({e['corpus']})" + (f": {e['detail']}" if e.get("detail") else "") for e in mine)]
    return "\n".join(lines)


def diff_json(entries: list[dict]) -> str:
    return json.dumps({"entries": entries}, ensure_ascii=False)


FIELDS = {"ids": ("node_id", "display_name", "score", "corpus")}
FIELDS["compact"] = (*FIELDS["ids"], "file_path", "line_start", "relevance", "source", "doc_source", "data_type", "bridged_from", "bridge_type", "connected")
FIELDS["full"] = (*FIELDS["compact"], "snippet")


def rows_of(results: list[dict], verbosity: str = "compact") -> str:
    """Search results with the fields of a verbosity, encoded."""
    if verbosity not in FIELDS:
        raise ValueError(f"verbosity must be one of {sorted(FIELDS)}")
    return encode({"results": [{f: r.get(f) if r.get(f) is not None else "" for f in FIELDS[verbosity]} for r in results]})
