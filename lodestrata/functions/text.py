"""Scalar functions as plain column expressions; none needs Python at run time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and what an index that strips marks makes of them.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżžș"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzzs"
#: The patterns that split an identifier into words.
CAMEL = (r"([a-z0-9])([A-Z])", r"([A-Z]+)([A-Z][a-z])")
#: A whole run without white space (tried at its start alone, so that long runs cost no more) that has a change of case, or a sign between letters or digits.
COMPOUND = r"(?<!\S)\S*?(?:[a-z0-9][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z0-9][^A-Za-z0-9\s]+[A-Za-z0-9])\S*"


def fold(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def tokens(text: Column) -> Column:
    """The index's tokens: runs of letters and digits, folded; null gives none."""
    return F.filter(F.split(F.coalesce(fold(text), F.lit("")), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def sub_words(token: Column) -> Column:
    """The lower-case words of one identifier."""
    spaced = F.regexp_replace(F.regexp_replace(token, CAMEL[0], "$1 $2"), CAMEL[1], "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[^A-Za-z0-9]+", " ")), " "), lambda t: t != "")


def split_identifiers(text: Column) -> Column:
    """``text``, followed by the words of its identifiers that have more than one.

    One regex finds the identifiers, so that plain words cost no more than that.
    """
    runs = F.regexp_extract_all(text, F.lit(COMPOUND), F.lit(0))
    words = F.array_join(F.flatten(F.transform(runs, sub_words)), " ")
    return F.concat(text, F.regexp_replace(words, "^(?=.)", " "))


def query_terms(query: Column) -> Column:
    """The ASCII terms of a query; repeated ones stay."""
    return F.regexp_extract_all(query, F.lit(r"([A-Za-z0-9]+)"), F.lit(1))


def match_expression(query: Column) -> Column:
    """The terms quoted and joined by OR; null without terms."""
    quoted = F.transform(query_terms(query), lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    return F.when(F.size(quoted) > 0, F.array_join(quoted, " OR "))


def snippet_tokens(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\w+)"), F.lit(1)), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets of tokens; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def method_name(name: Column) -> Column:
    """What stands after the last #; null without one."""
    return F.when(F.instr(name, "#") > 0, F.substring_index(name, "#", -1))


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut back to the last line feed in them if there is one, and a mark that it goes on."""
    head = F.substring(text, 1, most)
    back = F.instr(F.reverse(head), "\n")
    cut = F.when((back > 0) & (back < F.length(head)), F.concat(F.substring(head, F.lit(1), F.length(head) - back), F.lit("\n…"))).otherwise(F.concat(head, F.lit("\n…")))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def window(text: Column, query: Column, most: int) -> Column:
    """A stretch of ``most`` characters around the query's earliest hit; without a hit beyond the first stretch, ``truncate``."""
    words = F.array_distinct(F.flatten(F.transform(F.filter(F.split(query, r"\s+"), lambda t: t != ""), lambda t: F.concat(F.array(F.lower(t)), sub_words(t)))))
    hits = F.filter(F.transform(words, lambda w: F.instr(F.lower(text), w)), lambda p: p > 0)
    first = F.array_min(hits) - 1
    start = F.greatest(F.lit(0), F.least(first - most // 2, F.length(text) - most))
    body = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, F.lit(most)), F.when(start + most < F.length(text), "…").otherwise(""))
    return F.when(F.length(text) <= most, text).when(first >= most, body).otherwise(truncate(text, most))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def html_text(page: Column) -> Column:
    """The text of a page: no scripts and styles, tags as blanks, the common references as characters."""
    bare = F.regexp_replace(F.regexp_replace(page, r"(?is)<script\b.*?</script>", " "), r"(?is)<style\b.*?</style>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return trimmed(F.regexp_replace(bare, r"\s+", " "))


def slug(title: Column, most: int = 40, fallback: str | None = None) -> Column:
    """Lower case with dashes, at most ``most`` characters."""
    made = F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)
    return made if fallback is None else F.when(made == "", fallback).otherwise(made)


def frontmatter(text: Column) -> Column:
    """What stands between the --- lines at the top; '' without."""
    return F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---", 1)


def frontmatter_field(text: Column, name: str) -> Column:
    """A field's value without quotes; null without it."""
    value = F.regexp_extract(frontmatter(text), rf"(?m)^{name}:[ \t]*[\"']?([^\"'\r\n]*)", 1)
    return F.when(value != "", F.rtrim(value))


def published_date(path: Column, content: Column) -> Column:
    """YYYY-MM-DD from the frontmatter, else from news/Y/M[/D] in the path, else from that in the content; else null."""

    def from_news(text: Column) -> Column:
        pattern = r"news/(\d{4})/(\d{1,2})(?:/(\d{1,2})(?:\D|$))?"
        year, month, day = (F.regexp_extract(text, pattern, n) for n in (1, 2, 3))
        return F.when(year != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(F.when(day == "", "1").otherwise(day), 2, "0")))

    front = F.regexp_extract(frontmatter(content), r"(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.when(front != "", front), from_news(path), from_news(content))


def normal_date(date: Column) -> Column:
    """A date in any of the layouts that occur (year first, day first with dots, month names) as YYYY-MM-DD; else null."""
    text = trimmed(date)
    first = F.regexp_extract(text, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", 0)
    parts = [F.regexp_extract(text, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", n) for n in (1, 2, 3)]
    dotted = [F.regexp_extract(text, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", n) for n in (3, 2, 1)]
    iso = lambda p: F.concat_ws("-", p[0], F.lpad(p[1], 2, "0"), F.lpad(p[2], 2, "0"))
    return F.when(first != "", iso(parts)).when(dotted[0] != "", iso(dotted))


def strip_mdx(text: Column) -> Column:
    """Without frontmatter, imports, exports, comments and component tags; three line feeds or more become two."""
    bare = F.regexp_replace(text, r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "")
    bare = F.regexp_replace(bare, r"(?m)^(?:import|export)\s.*$", "")
    bare = F.regexp_replace(bare, r"(?s)\{/\*.*?\*/\}", "")
    bare = F.regexp_replace(bare, r"</?[A-Z][A-Za-z0-9.]*(?:\s[^<>]*)?/?>", "")
    return trimmed(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


def docs_kind(path: Column, content: Column) -> Column:
    """changelog, tutorial, reference or guide, by path, then by the number of code fences."""
    low = F.lower(path)
    fences = F.regexp_count(content, F.lit(r"(?m)^```"))
    return F.when(low.rlike("changelog|release|patch|news"), "changelog").when(low.rlike("tutorial|getting-started|quickstart|how-to"), "tutorial").when(low.rlike("reference|api") | (fences / 2 >= 6), "reference").otherwise("guide")


def signature(body: Column) -> Column:
    """The first line that is neither empty, comment nor annotation; '' if there is none."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), trimmed)
    real = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(//|/\*|\*|@)"))
    return F.coalesce(F.try_element_at(real, F.lit(1)), F.lit(""))


def metadata_facets(metadata: Column) -> dict[str, Column]:
    """visibility, annotation names and thinness from a metadata text; null where absent."""
    visibility = F.regexp_extract(metadata, r'"visibility"\s*:\s*"([^"]*)"', 1)
    inner = F.regexp_extract(metadata, r'"annotations"\s*:\s*\[(.*)\]', 1)
    names = F.regexp_extract_all(inner, F.lit(r'"name"\s*:\s*"([^"]*)"'), F.lit(1))
    return {"visibility": F.when(visibility != "", visibility), "annotations": F.when(inner != "", F.array_join(F.array_distinct(names), ",")), "thin": F.coalesce(metadata.rlike(r'"thin"\s*:\s*true'), F.lit(False))}


def glob_pattern(glob: Column) -> Column:
    """A glob with * as an anchored regular expression."""
    quoted = F.regexp_replace(glob, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("$"))


def source_path(path: Column) -> Column:
    """What follows a staging folder, without leading slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*cache/staged/[^/]+/", ""), r"^/+", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def class_matches(node_id: Column, name: str) -> Column:
    """Whether the class of an id is just ``name``, with or without its package; case counts."""
    full = F.regexp_replace(F.substring_index(node_id, "#", 1), "^class:", "")
    return (full == name) | (F.substring_index(full, ".", -1) == name)


def path_matches(path: Column, value: str) -> Column:
    """Whether ``value`` is the file's name, or a whole stretch of folders and file where it first occurs."""
    at = F.instr(path, f"/{value}")
    after = F.substring(path, at + len(value) + 1, F.lit(1))
    return (basename(path) == value) | ((at > 0) & ((after == "") | (after == "/")))


def contains_ci(text: Column, part: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(part.lower()))


def significance(node_id: Column, corpus: Column, data_type: Column, change: Column) -> Column:
    """HIGH, MEDIUM or LOW: what is public, added or removed weighs more."""
    protocol = F.contains(F.lower(node_id), F.lit("protocol"))
    return F.when(protocol, "HIGH").when((corpus == "gamedata") & change.isin("ADDED", "REMOVED"), "HIGH").when((corpus == "code") & change.isin("ADDED", "REMOVED"), "MEDIUM").when(corpus.isin("gamedata", "client"), "MEDIUM").otherwise("LOW")


#: What words of a query ask for which data types.
INTENTS = (
    ("craft|recipe|crafting|bench|smelt|cook|brew", ("recipe", "item")),
    ("npc|mob|creature|enemy", ("npc", "npc_group")),
    ("block|ore|stone|wood|plank", ("block",)),
    ("farm|farming|crop|grow|plant|seed|harvest", ("farming", "item")),
    ("shop|merchant|vendor|buy|sell|trade", ("shop",)),
    ("biome|zone|climate", ("biome",)),
    ("weather|rain|snow|storm", ("weather",)),
    ("objective|quest|mission|task|bounty", ("objective",)),
)


def intents(query: Column) -> Column:
    """The data types that a query's words ask for, in order and once; null if none do."""
    rules = [F.when(query.rlike(r"(?i)\b(?:drop|loot)s?\s+from\b"), F.array(F.lit("drop"), F.lit("npc")))]
    rules += [F.when(query.rlike(rf"(?i)\b(?:{words})s?\b"), F.array(*map(F.lit, types))) for words, types in INTENTS]
    found = F.array_distinct(F.flatten(F.array(*(F.coalesce(r, F.array().cast("array<string>")) for r in rules))))
    return F.when(F.size(found) > 0, F.array_join(found, ","))


#: What a question looks like, in order; the first group is the entity.
ROUTES = (
    (r"(?:what|which|classes?|types?)\s+(?:extends?|inherits?|subclass(?:es)?(?:\s+of)?)\s+(\w+)", "GRAPH", "EXTENDS"),
    (r"(?:what|which|classes?|types?)\s+(?:implements?)\s+(\w+)", "GRAPH", "IMPLEMENTS"),
    (r"(?:what|who|which)\s+(?:calls?|invokes?)\s+(\w+(?:\.\w+)?)", "GRAPH", "CALLS"),
    (r"(?:methods?|functions?)\s+(?:of|in|on)\s+(\w+)", "GRAPH", "CONTAINS"),
    (r"(?:how|what)\s+(?:to\s+)?(?:craft|make|produce|create)\s+(\w+)", "HYBRID", "REQUIRES_ITEM"),
    (r"(?:what|which)\s+(?:drops?|loot)\s+(?:from|by)\s+(\w+)", "GRAPH", "DROPS_ON_DEATH"),
    (r"(?:what|which)\s+(?:uses?|requires?|needs?)\s+(\w+)", "GRAPH", "REQUIRES_ITEM"),
    (r"(?:where|who)\s+(?:to\s+)?(?:buy|sells?|trade)\s+(\w+)", "GRAPH", "OFFERED_IN_SHOP"),
    (r"(?:what|which)\s+(?:ui|screen|panel|view)\s+(?:shows?|displays?|contains?|for)\s+(\w+)", "GRAPH", "UI_BINDS_TO"),
)
FIND = r"(?i)(?:find|show|get|where\s+is)\s+(?:class\s+)?(\w+)"
CAPITALISED = r"\b([A-Z]\w{2,})\b"


def route_rule(query: Column) -> Column:
    """struct(strategy, relation, entity) of the first rule that a query meets; null if it meets none."""
    rules = [F.when(query.rlike(f"(?i){p}"), F.struct(F.lit(strategy).alias("strategy"), F.lit(relation).alias("relation"), F.regexp_extract(query, f"(?i){p}", 1).alias("entity"))) for p, strategy, relation in ROUTES]
    return F.coalesce(*rules)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
