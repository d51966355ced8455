"""Scalar expressions: safe numbers, JSON paths, keys in file names, natural order, names fit for files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """c as a double; null where it is no number or NaN."""
    value = c.try_cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def rounded(c: Column, digits: int) -> Column:
    """F.round() of a double, the same but in double arithmetic, which is many times as fast, where no half is near."""
    y = c * 10.0**digits
    near = F.floor(y)
    return F.when((F.abs(y) < 2.0**43) & (F.abs(y - near - 0.5) > 1e-3), (near + (y - near > 0.5).cast("long")) / 10.0**digits).otherwise(F.round(c, digits))


def nonzero(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def at_path(doc: Column, path: str, kind: str = "double") -> Column:
    """The value at a dotted path of a VARIANT; null on a missing hop or another type."""
    return F.try_variant_get(doc, "$." + path, kind)


def first_key(doc: Column, *paths: str) -> Column:
    """The number at the first path that is present, a null there included: presence decides, not the value."""
    out = F.lit(None).cast("double")
    for p in reversed(paths):
        out = F.when(F.try_variant_get(doc, "$." + p, "variant").isNotNull(), at_path(doc, p)).otherwise(out)
    return out


def group_or_null(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def interval_gen(name: Column) -> Column:
    """(interval, gen_frame) in a run's name; both null without a gen number. A plain gen after the interval goes first."""
    low = F.lower(name)
    interval = group_or_null(low, r"interval[_-]?(\d+)")
    framed = group_or_null(low, r"gen[_-]?frame[_-]?(\d+)")
    behind = group_or_null(low, r"interval[_-]?\d+.*?gen[_-]?(\d+)")
    anywhere = group_or_null(low, r"gen[_-]?(\d+)")
    gen = F.coalesce(framed, behind, anywhere)
    return F.struct(F.when(gen.isNotNull(), interval.cast("int")).alias("interval"), gen.cast("int").alias("gen_frame"))


def strict_interval_gen(name: Column, parent: Column) -> Column:
    """(interval, gen_frame) where both stand in the name, else in the parent folder's."""
    one = lambda c, key: group_or_null(c, rf"{key}[_-]?(\d+)").cast("int")
    both = one(name, "interval").isNotNull() & one(name, "gen[_-]?frame").isNotNull()
    own = lambda key: F.when(both, one(name, key)).otherwise(one(parent, key))
    interval, gen = own("interval"), own("gen[_-]?frame")
    found = interval.isNotNull() & gen.isNotNull()
    return F.struct(F.when(found, interval).alias("interval"), F.when(found, gen).alias("gen_frame"))


def run_parameters(path: Column) -> Column:
    """interval, gen_frame, prompt and gen in a path as texts; NA where missing."""
    one = lambda pattern: F.coalesce(group_or_null(path, pattern), F.lit("NA"))
    return F.struct(
        one(r"interval[_-]?(\d+)").alias("interval"), one(r"gen[_-]?frame[_-]?(\d+)").alias("gen_frame"), one(r"prompt[_-]?(\d+)").alias("prompt"), one(r"prompt[_-]?\d+[_-]?gen[_-]?(\d+)").alias("gen")
    )


def run_name(path: Column) -> Column:
    """A run's name after its path's parameters, in the fixed form of results; a gen number may also end a folder's name."""
    p = run_parameters(path)
    gen = F.coalesce(F.nullif(p["gen"], F.lit("NA")), group_or_null(path, r"(?i)gen[_-]?(\d+)(?:$|[_/\\])"), F.lit("NA"))
    return F.concat(F.lit("interval"), p["interval"], F.lit("_genframe"), p["gen_frame"], F.lit("_prompt"), p["prompt"], F.lit("_gen"), gen)


def nearest_frames(path: Column) -> Column:
    """The gen_frame number of the nearest folder: the last one in the path."""
    return group_or_null(path, r"(?i)^.*gen[_-]?frame[_-]?(\d+)").cast("int")


def file_name(name: Column, default: str = "batch_run") -> Column:
    """name fit for a file: bad characters as _, runs of _ as one, the last 200 characters."""
    out = F.regexp_replace(F.replace(name, F.lit(".."), F.lit("_")), r"[^A-Za-z0-9._-]+", "_")
    out = F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.right(out, F.lit(200)), F.lit("")), F.lit(default))


def last_parts(path: Column, n: int = 3) -> Column:
    """The last n parts of a path, joined by _."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), "_")


def cut_at(text: Column, n: int) -> Column:
    """(head, tail) around the n-th underscore; null with fewer."""
    enough = F.size(F.split(text, "_", -1)) > n
    head = F.substring_index(text, "_", n)
    return F.when(enough, F.struct(head.alias("head"), F.substr(text, F.length(head) + 2).alias("tail")))


def stem(name: Column) -> Column:
    """A file's name up to its first .mid or .midi in any case, else without its last suffix."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.when(base.rlike(r"(?i)\.midi?"), F.regexp_replace(base, r"(?i)\.midi?.*$", "")).otherwise(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""))


def run_folder(key: Column) -> Column:
    """interval_I_gen_frame_G/rest of a key intervalI_genG_rest; other keys as they are."""
    pattern = r"^interval(\d+)_gen(\d+)_(.*)$"
    return F.when(key.rlike(pattern), F.regexp_replace(key, pattern, "interval_$1_gen_frame_$2/$3")).otherwise(key)


def report_id(name: Column) -> Column:
    """The tokens before the token `prompt`, six at most."""
    parts = F.split(name, "_")
    at = F.array_position(F.transform(parts, lambda p: p.rlike("^prompt")), F.lit(True)).cast("int")
    return F.array_join(F.slice(parts, F.lit(1), F.least(F.when(at > 0, at - 1).otherwise(F.size(parts)), F.lit(6))), "_")


def natural_key(name: Column) -> Column:
    """Order by alternating text and number: an array of (text, padded digits)."""
    low, pattern = F.lower(name), F.lit(r"(\D*)(\d*)")
    pairs = F.arrays_zip(F.regexp_extract_all(low, pattern, F.lit(1)).alias("t"), F.regexp_extract_all(low, pattern, F.lit(2)).alias("d"))
    return F.transform(pairs, lambda p: F.struct(p["t"], F.when(p["d"] == "", "").otherwise(F.lpad(p["d"], 20, "0"))))


def group_label(name: Column) -> Column:
    """(group, member) of a report's label: intervalN or offline, and genN, blank where offline."""
    offline = F.lower(name).contains("offline")
    interval = F.concat(F.lit("interval"), group_or_null(F.lower(name), r"interval[_-]?(\d+)"))
    gen = F.concat(F.lit("gen"), group_or_null(F.lower(name), r"gen(?:[_-]?frame)?[_-]?(\d+)"))
    return F.struct(F.when(offline, "offline").otherwise(F.coalesce(interval, name)).alias("group"), F.when(offline, "").otherwise(F.coalesce(gen, F.lit(""))).alias("member"))


def fixed(c: Column, digits: int = 4) -> Column:
    """c with so many decimals, n/a where it is no number."""
    return F.when(c.isNull() | F.isnan(c), "n/a").otherwise(F.format_string(f"%.{digits}f", c))


def header(columns: list[str], wanted: str) -> str | None:
    """The column that is `wanted`: equal, else equal in letters and digits, else one containing the other."""
    plain = lambda s: "".join(x for x in s.lower() if x.isalnum())
    for fits in (lambda c: c == wanted, lambda c: plain(c) == plain(wanted), lambda c: plain(wanted) in plain(c) or plain(c) in plain(wanted)):
        for c in columns:
            if plain(c) and fits(c):
                return c
    return None
