"""String, path, number-format and value functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def left_trim(text: Column, char: str) -> Column:
    return F.regexp_replace(text, "^\\Q" + char + "\\E+", "")


def right_trim(text: Column, char: str) -> Column:
    return F.regexp_replace(text, "\\Q" + char + "\\E+$", "")


def trim(text: Column, char: str) -> Column:
    return left_trim(right_trim(text, char), char)


def replaced(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text) if prefix else text


def without_suffix(text: Column, suffix: str) -> Column:
    return F.when(text.endswith(suffix), F.left(text, F.length(text) - len(suffix))).otherwise(text) if suffix else text


def joined_path(*parts: Column) -> Column:
    """Parts with one `/` between them; a part's first `/` and what ends in one are not doubled."""

    def join(done: Column, part: Column) -> Column:
        part = F.regexp_replace(part, "^/", "")
        return F.when(done.endswith("/"), F.concat(done, part)).otherwise(F.concat(done, F.lit("/"), part))

    return reduce(join, parts)


def sample_name(label: Column, number: Column, suffix: str) -> Column:
    """`label_number_suffix`, the naming convention of sample files: six and eight digits."""
    return F.concat(F.lpad(label.cast("string"), 6, "0"), F.lit("_"), F.lpad(number.cast("string"), 8, "0"), F.lit(suffix))


def sample_label(path: Column) -> Column:
    return F.regexp_extract(path, r"([0-9]+)_[0-9]+[^/]*$", 1).try_cast("int")


def sample_number(path: Column) -> Column:
    return F.regexp_extract(path, r"[0-9]+_([0-9]+)[^/]*$", 1).try_cast("int")


def absolute(path: Column, folder: str) -> Column:
    """A path seen from `folder`, without `.`, `..` and empty parts."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path))
    step = lambda done, x: F.when((x == ".") | (x == ""), done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/"))


# --- a hash of strings in 64-bit arithmetic that wraps round


def _plus(a: Column, b: Column) -> Column:
    low = a.bitwiseAND(0xFFFFFFFF) + b.bitwiseAND(0xFFFFFFFF)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(0xFFFFFFFF))


def string_number(text: Column) -> Column:
    """One-at-a-time hash of the bytes of an ASCII text as a signed 64-bit number."""

    def byte(h: Column, c: Column) -> Column:
        h = _plus(h, F.ascii(c).cast("long"))
        h = _plus(h, F.shiftleft(h, 10))
        return h.bitwiseXOR(F.shiftright(h, 6))

    def last(h: Column) -> Column:
        h = _plus(h, F.shiftleft(h, 3))
        h = h.bitwiseXOR(F.shiftright(h, 11))
        return _plus(h, F.shiftleft(h, 15))

    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("long"), byte, last)


# --- hexadecimal colours


def hex_of_colour(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("%02X%02X%02X", *(c.cast("int") for c in (r, g, b)))


def colour_of_hex(text: Column) -> list[Column]:
    """R, G, B of `#XXXXXX`; null for anything else."""
    sound = text.rlike("^#[a-fA-F0-9]{6}$")
    return [F.when(sound, F.conv(F.substring(text, k, 2), 16, 10).cast("int")) for k in (2, 4, 6)]


# --- tables of values


def inserted(table: Column, key: Column, value: Column) -> Column:
    """The map with a key's value, new or in place of the old one."""
    return F.map_concat(removed(table, key), F.create_map(key, value))


def removed(table: Column, key: Column) -> Column:
    return F.map_filter(table, lambda k, _: k != key)


def first_entry(table: Column) -> Column:
    """The entry (key, value) of the least key."""
    return F.array_min(F.map_entries(table))


def next_entry(table: Column, key: Column) -> Column:
    """The entry of the least key above `key`, null after the last one."""
    return F.array_min(F.filter(F.map_entries(table), lambda e: e["key"] > key))


def numbered_values(values: Column) -> Column:
    """An array as a map from positions, from 0."""
    return F.map_from_arrays(F.transform(values, lambda _, k: k), values)


def minified(table: Column) -> Column:
    """A map as JSON without white space, keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(table))))


def json_array(doc: Column, path: str, kind: str = "double") -> Column:
    """The array, or array of arrays, at keys separated by `:`; kind is of its elements."""
    return F.from_json(F.get_json_object(doc, "$." + path.replace(":", ".")), f"array<{kind}>")


def json_map(doc: Column, path: str = "") -> Column:
    """The object at keys separated by `:` as a map of texts."""
    return F.from_json(F.get_json_object(doc, "$." + path.replace(":", ".")) if path else doc, "map<string,string>")


def json_with(doc: Column, key: str, value: Column) -> Column:
    """The flat JSON object with one more or another value."""
    return minified(inserted(json_map(doc), F.lit(key), value.cast("string")))


def json_without(doc: Column, key: str) -> Column:
    return minified(removed(json_map(doc), F.lit(key)))


# --- times


def elapsed_ms(begin: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(begin)) / 1000


def duration(ms: Column) -> Column:
    """Milliseconds in words, without units that are zero; under one with six decimals."""
    whole = ms.cast("long")
    units = [(86_400_000, None, "day(s) "), (3_600_000, 24, "hour(s) "), (60_000, 60, "min(s) "), (1000, 60, "sec(s) "), (1, 1000, "ms")]
    parts = []
    for size, most, name in units:
        n = F.floor(whole / size) if most is None else F.floor(whole / size) % most
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(" " + name))).otherwise(""))
    return F.when(ms < 1, F.format_string("%f ms", ms.cast("double"))).otherwise(F.concat(*parts))
