"""Identity of files, chunks, people and addresses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions import vocab as V
from corpuscle.functions.text import any_of, bind, col, strip


def first_non_blank(*columns: Column | str) -> Column:
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns])


def parse_ts(c: Column | str) -> Column:
    """ISO text to timestamp; what cannot be read is null."""
    return F.try_to_timestamp(col(c))


def basename(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"[^/]*$", 0)


def dedup_key(id_: Column | str, source: Column | str, page: Column | str, content: Column | str) -> Column:
    """The row's id; else source and page; else its content."""
    by_place = F.concat_ws(":", F.coalesce(col(source), F.lit("")), F.coalesce(col(page).cast("string"), F.lit("")))
    return (
        F.when(col(id_).isNotNull(), F.concat(F.lit("db_id:"), col(id_).cast("string")))
        .when(F.trim(by_place) != "", F.concat(F.lit("meta:"), F.left(F.sha2(F.trim(by_place), 256), F.lit(12))))
        .otherwise(F.concat(F.lit("content:"), F.left(F.sha2(col(content), 256), F.lit(20))))
    )


def _meta(metadata: Column, key: str) -> Column:
    return F.nullif(F.get_json_object(metadata, f"$.{key}"), F.lit(""))


def file_name(metadata: Column | str) -> Column:
    """Name in the metadata; else the source's base name, or the title of a temporary file."""
    m = col(metadata)
    source, title = _meta(m, "source"), _meta(m, "title")
    temporary = any_of([source.contains(mark) for mark in V.TEMP_PATH_MARKS])
    return F.coalesce(
        _meta(m, "original_file_name"),
        F.when(temporary, title),
        F.nullif(basename(source), F.lit("")),
        F.lit("unknown"),
    )


def file_id(metadata: Column | str) -> Column:
    """Id in the metadata; else a hash of the name."""
    return F.coalesce(_meta(col(metadata), "original_file_id"), F.md5(file_name(metadata)))


def object_path(content_hash: Column | str, name: Column | str) -> Column:
    """Content-addressed path: hash plus the name's extension (`.pdf` when it has none)."""
    ext = F.regexp_extract(basename(name), r"[^.](\.[^.]*)$", 1)
    return F.concat(col(content_hash), F.when(ext == "", ".pdf").otherwise(ext))


def sanitize_filename(name: Column | str, max_length: int = 200) -> Column:
    """Allow-listed characters only; unprintable ones are dropped first.

    Of a long name the start is cleaned first. It ends in a letter, digit or hyphen once trimmed, so what follows
    cannot change it; if it is too short for a result, the whole name is cleaned.
    """
    name = F.coalesce(col(name), F.lit(""))

    def safe(c: Column) -> Column:
        printable = F.regexp_replace(c, r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", "")
        return F.btrim(F.regexp_replace(printable, V.UNSAFE_FILENAME_PATTERN, "_"), F.lit(" ._"))

    start = safe(F.left(name, F.lit(2 * max_length)))
    whole = bind(safe(name), lambda s: F.left(F.when(s == "", V.DEFAULT_FILENAME).otherwise(s), F.lit(max_length)))
    enough = (F.length(name) > 2 * max_length) & (F.length(start) >= max_length)
    return F.when(enough, F.left(start, F.lit(max_length))).otherwise(whole)


def sniff_type(content: Column | str) -> Column:
    """Media type by leading bytes; null when unknown."""
    c = col(content)

    def at(start: int, size: int, hexes: str) -> Column:
        return F.hex(F.substring(c, start, size)) == hexes

    return (
        F.when(at(1, 5, "255044462D"), "application/pdf")
        .when(at(1, 3, "FFD8FF"), "image/jpeg")
        .when(at(1, 8, "89504E470D0A1A0A"), "image/png")
        .when(at(1, 2, "424D"), "image/bmp")
        .when(at(1, 4, "52494646") & at(9, 4, "57454250"), "image/webp")
        .when((F.length(c) > 12) & at(5, 4, "66747970"), "video/mp4")
        .when(at(1, 4, "1A45DFA3"), "video/webm")
    )


def mask_email(email: Column | str) -> Column:
    e = col(email)
    masked = F.concat(F.left(e, F.lit(1)), F.lit("***"), F.regexp_extract(e, r"(?s)@.*$", 0))
    return (
        F.when(e.isNull() | ~e.contains("@"), "***")
        .when(e.startswith("@"), F.concat(F.lit("***"), e))
        .otherwise(masked)
    )


def client_ip(forwarded: Column | str, peer: Column | str, hops: int = 2) -> Column:
    """n-th address from the right of a forwarded list; else the direct peer."""
    if hops <= 0:
        return col(peer)
    parts = F.filter(F.transform(F.split(F.coalesce(col(forwarded), F.lit("")), ","), strip), lambda p: p != "")
    return F.when(F.size(parts) >= hops, F.try_element_at(parts, F.lit(-hops))).otherwise(col(peer))


def normalized_role(role: Column | str) -> Column:
    return F.when(F.lower(col(role)).isin("admin", "administrator"), "admin").otherwise("user")
