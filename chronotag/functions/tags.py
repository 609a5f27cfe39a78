"""Tagset functions as Column expressions.

A tagset is a sorted, duplicate-free array of (name, value) structs. In a filter a null value
means "any value" and an empty value means "bind to what a filter to the left matched".
"""

from __future__ import annotations

from urllib.parse import quote_plus, unquote_plus

from pyspark.sql import Column
from pyspark.sql import functions as F

# A name or value is URL-encoded only when it holds one of these.
ENCODE_WHEN = "%=,\t\n :;+"
_ENCODE_RE = f"[{ENCODE_WHEN}]"

EMPTY = "cast(array() as array<struct<name:string,value:string>>)"


# --- literal tagsets (driver side, used for filters) ---------------------------------------

def encode_text(s: str) -> str:
    return quote_plus(s).replace("%2F", "/") if set(s) & set(ENCODE_WHEN) else s


def decode_text(s: str) -> str:
    return unquote_plus(s) if "%" in s or "+" in s else s


def parse(text: str | None) -> list[tuple[str, str | None]]:
    """`n1=v1,n2=v2,n3` to sorted pairs; a name without `=` has a null value."""
    pairs = set()
    for item in (text or "").split(","):
        if not item:
            continue
        name, eq, value = item.partition("=")
        pairs.add((decode_text(name), decode_text(value) if eq else None))
    return sorted(pairs, key=lambda p: (p[0], p[1] is not None, p[1] or ""))


def parse_many(text: str) -> list[list[tuple[str, str | None]]]:
    """Alternatives separated by `;`."""
    return [parse(t) for t in text.split(";")]


def text_of(pairs) -> str:
    return ",".join(encode_text(n) if v is None else f"{encode_text(n)}={encode_text(v)}"
                    for n, v in pairs)


def lit_tags(tags: str | list | None) -> Column:
    """A constant tagset column."""
    pairs = parse(tags) if tags is None or isinstance(tags, str) else list(tags)
    if not pairs:
        return F.expr(EMPTY)
    return F.array(*[_pair(F.lit(n), F.lit(v)) for n, v in pairs])


def _pair(name: Column, value: Column) -> Column:
    return F.struct(name.cast("string").alias("name"), value.cast("string").alias("value"))


# --- text form -----------------------------------------------------------------------------

def encode(s: Column) -> Column:
    return F.when(s.rlike(_ENCODE_RE), F.replace(F.url_encode(s), F.lit("%2F"), F.lit("/"))).otherwise(s)


def decode(s: Column) -> Column:
    return F.when(s.rlike("[%+]"), F.coalesce(F.try_url_decode(s), s)).otherwise(s)


def canonical(tags: Column) -> Column:
    """Sort by name then value and drop repeats; a null value sorts first."""
    return F.array_sort(F.array_distinct(tags))


def make(**tags) -> Column:
    """A tagset from columns: make(user=F.col('user_id'))."""
    return F.array(*[_pair(F.lit(n), c) for n, c in sorted(tags.items())])


def to_text(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda p: F.when(p["value"].isNull(), encode(p["name"]))
                                    .otherwise(F.concat(encode(p["name"]), F.lit("="), encode(p["value"])))), ",")


def from_text(text: Column) -> Column:
    items = F.filter(F.split(text, ","), lambda s: s != "")
    return canonical(F.transform(items, lambda s: _pair(
        decode(F.substring_index(s, "=", 1)),
        F.when(F.contains(s, F.lit("=")), decode(F.substr(s, F.instr(s, "=") + F.lit(1)))))))


def to_array(tags: Column) -> Column:
    """Flat array name1, value1, name2, value2."""
    return F.flatten(F.transform(tags, lambda p: F.array(p["name"], p["value"])))


def from_array(flat: Column) -> Column:
    positions = F.filter(F.sequence(F.lit(0), F.greatest(F.size(flat) - 1, F.lit(0))),
                         lambda i: (i % 2 == 0) & (i + 1 < F.size(flat)))
    return canonical(F.transform(positions, lambda i: _pair(F.get(flat, i), F.get(flat, i + 1))))


# --- reading -------------------------------------------------------------------------------

def values(tags: Column, name: str | Column) -> Column:
    key = F.lit(name) if isinstance(name, str) else name
    return F.transform(F.filter(tags, lambda p: p["name"] == key), lambda p: p["value"])


def value(tags: Column, name: str | Column) -> Column:
    """The first value of a name, null when the name is missing."""
    return F.get(values(tags, name), F.lit(0))


def names(tags: Column) -> Column:
    return F.array_distinct(F.transform(tags, lambda p: p["name"]))


def has_name(tags: Column, name: str) -> Column:
    return F.exists(tags, lambda p: p["name"] == F.lit(name))


def has_value(tags: Column, value_: str) -> Column:
    return F.exists(tags, lambda p: p["value"] == F.lit(value_))


def has_pair(tags: Column, name: str, value_: str) -> Column:
    return F.exists(tags, lambda p: (p["name"] == F.lit(name)) & (p["value"] == F.lit(value_)))


def size(tags: Column) -> Column:
    return F.size(tags)


def contains(tags: Column, wanted, promoted: dict[str, Column] | None = None) -> Column:
    """Every pair of the literal tagset is present; a null value accepts any value of its name.

    Names in `promoted` are tested on a plain column, which Parquet can filter on. An empty
    tagset puts no condition on the row.
    """
    pairs = parse(wanted) if isinstance(wanted, str) else wanted
    promoted = promoted or {}
    test = F.lit(True)
    for name, val in pairs:
        if name in promoted:
            col = promoted[name]
            test = test & (col.isNotNull() if val is None else col == F.lit(val))
        else:
            test = test & (has_name(tags, name) if val is None else has_pair(tags, name, val))
    return test


def contains_all(tags: Column, wanted: Column) -> Column:
    """As `contains`, with the wanted tagset in a column."""
    return F.forall(wanted, lambda w: F.exists(
        tags, lambda p: (p["name"] == w["name"]) & (w["value"].isNull() | (p["value"] == w["value"]))))


# --- changing ------------------------------------------------------------------------------

def add(tags: Column, more: Column) -> Column:
    return canonical(F.concat(tags, more))


def set_(tags: Column, new: Column) -> Column:
    """Replace all values of the names in `new`."""
    kept = F.filter(tags, lambda p: ~F.exists(new, lambda n: n["name"] == p["name"]))
    return canonical(F.concat(kept, new))


def remove(tags: Column, gone: Column) -> Column:
    """Remove pairs; a null value in `gone` removes every value of the name."""
    return F.filter(tags, lambda p: ~F.exists(
        gone, lambda g: (g["name"] == p["name"]) & (g["value"].isNull() | (g["value"] == p["value"]))))


def template(shape: Column, source: Column) -> Column:
    """Values of the names in `shape`: null values are taken from `source`, others kept."""
    open_names = F.filter(shape, lambda s: s["value"].isNull())
    filled = F.filter(source, lambda p: F.exists(open_names, lambda s: s["name"] == p["name"]))
    return canonical(F.concat(F.filter(shape, lambda s: s["value"].isNotNull()), filled))


def derive(union: Column, change: Column) -> Column:
    """Union of tags, then changed: a null value removes the name, another value replaces it."""
    drop = F.filter(change, lambda c: c["value"].isNull())
    put = F.filter(change, lambda c: c["value"].isNotNull())
    return set_(remove(union, drop), put)


def intersect(a: Column, b: Column) -> Column:
    """Common pairs; a wildcard on one side adopts the values of the other."""
    def adopt(x, y):
        return F.filter(x, lambda p: F.exists(y, lambda q: (q["name"] == p["name"]) & (
            q["value"].isNull() | (q["value"] == p["value"]))))
    return canonical(F.concat(adopt(a, b), adopt(b, a)))


def inherit(spec: str | list, sources: dict[str, tuple[Column, Column]]) -> Column:
    """Result tags built from inputs.

    `sources` maps an input name to its (tags, id) columns. In `spec`
    `name=input.tag` copies one tag, `name=input.ID` the input's id, `*=input.*` all tags,
    `p.*=input.*` all tags under a prefix; anything else is a constant. Wildcards never override
    what is named explicitly.
    """
    explicit, wild = [], []
    for name, val in (parse(spec) if isinstance(spec, str) else spec):
        src, dot, field = (val or "").rpartition(".")
        literal = F.array(_pair(F.lit(name), F.lit(val)))
        if not dot or src not in sources:
            explicit.append(literal)
        elif field == "*":
            wild.append(_renamed(sources[src][0], name))
        elif field == "ID":
            explicit.append(F.array(_pair(F.lit(name), sources[src][1])))
        else:
            found = values(sources[src][0], field)
            explicit.append(F.when(F.size(found) == 0, literal).otherwise(_named(found, name.replace("*", field))))
    given = canonical(F.concat(F.expr(EMPTY), *explicit))
    extra = [_names_missing_from(tags, given) for tags in wild]
    return canonical(F.concat(given, *extra)) if extra else given


def _named(vals: Column, name: str) -> Column:
    return F.transform(vals, lambda v: _pair(F.lit(name), v))


def _renamed(tags: Column, name: str) -> Column:
    """Every tag under the name with its `*` replaced by the tag's own name."""
    before, star, after = name.partition("*")
    if not star:
        return F.transform(tags, lambda p: _pair(F.lit(name), p["value"]))
    return F.transform(tags, lambda p: _pair(F.concat(F.lit(before), p["name"], F.lit(after)), p["value"]))


def _names_missing_from(tags: Column, present: Column) -> Column:
    return F.filter(tags, lambda p: ~F.exists(present, lambda q: q["name"] == p["name"]))


def negative(x: Column) -> Column:
    """Negation that never gives minus zero."""
    return F.when(x == 0, F.lit(0.0)).otherwise(-x)
