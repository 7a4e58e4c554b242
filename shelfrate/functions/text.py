"""Text helpers as Column expressions: ids, cursors, keys, name checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's): feed file-name pattern, its
# length limit, the cache-key prefix and resource labels.
FEED_FILE_PATTERN = r"(?i)^[A-Za-z0-9._-]+\.csv\z"
FEED_FILE_MAX = 255
VENDOR_ID_MAX = 64
PRODUCT_KEY_PREFIX = "product:"
RESOURCE_PRODUCT = "product"
RESOURCE_OTHER = "other"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def deterministic_uuid(namespace: Column, key: Column) -> Column:
    """UUID-shaped text from md5(namespace ':' key) — reruns give the
    same id (no ``uuid()``/``rand()`` in operators)."""
    h = F.md5(F.concat(namespace, F.lit(":"), key.cast("string")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def decimal_sort_text(m) -> Column:
    """Decimal as the shortest text (no trailing zeros): 75.00 -> '75', 0.10 -> '0.1'."""
    s = _c(m).cast("string")
    return F.when(F.instr(s, ".") > 0,
                  F.regexp_replace(F.regexp_replace(s, r"0+\z", ""), r"\.\z", "")).otherwise(s)


def encode_cursor(sort_value: Column, id_value: Column) -> Column:
    """base64url(JSON {"s": sort, "i": id}) without padding."""
    js = F.to_json(F.struct(sort_value.cast("string").alias("s"), id_value.cast("string").alias("i")))
    b64 = F.base64(F.encode(js, "UTF-8"))
    return F.regexp_replace(F.translate(b64, "+/", "-_"), "=+\\z", "")


def decode_cursor(cursor) -> Column:
    """struct(s, i) or NULL on any defect (bad base64, bad JSON, not an
    object, ``s`` or ``i`` missing or not JSON strings)."""
    std = F.translate(_c(cursor), "-_", "+/")
    padded = F.concat(std, F.repeat(F.lit("="), ((F.lit(4) - F.length(std) % 4) % 4).cast("int")))
    raw = F.try_to_binary(padded, F.lit("base64"))
    v = F.try_parse_json(raw.cast("string"))
    s_v, i_v = F.variant_get(v, "$.s", "variant"), F.variant_get(v, "$.i", "variant")
    ok = (F.schema_of_variant(s_v) == "STRING") & (F.schema_of_variant(i_v) == "STRING")
    return F.when(ok, F.struct(F.variant_get(v, "$.s", "string").alias("s"),
                               F.variant_get(v, "$.i", "string").alias("i")))


def keyset_after(sort_col: str, id_col: str, sort_value: Column, id_value: Column,
                 direction: str = "asc") -> Column:
    """(f > v) OR (f = v AND id > i); ``<`` for descending."""
    f, i = F.col(sort_col), F.col(id_col)
    if direction == "asc":
        return (f > sort_value) | ((f == sort_value) & (i > id_value))
    return (f < sort_value) | ((f == sort_value) & (i < id_value))


def object_key_parts(key) -> Column:
    """S7: '+' -> space, URL-decode, then ``raw/{vendor}/{rest}``.
    Returns struct(vendor_id, source_file)."""
    decoded = F.try_url_decode(F.regexp_replace(_c(key), r"\+", " ")) if hasattr(F, "try_url_decode") \
        else F.url_decode(F.regexp_replace(_c(key), r"\+", " "))
    parts = F.split(decoded, "/")
    rest = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), "/")
    return F.struct(F.try_element_at(parts, F.lit(2)).alias("vendor_id"),
                    F.when(F.size(parts) >= 3, rest).otherwise(F.lit("")).alias("source_file"))


def feed_file_error(name) -> Column:
    """Why a feed file name is refused, or NULL."""
    n = _c(name)
    return (F.when(n.isNull(), F.lit("sourceFile: Required"))
             .when(F.length(n) < 1, F.lit("sourceFile: String must contain at least 1 character(s)"))
             .when(F.length(n) > FEED_FILE_MAX,
                   F.lit(f"sourceFile: String must contain at most {FEED_FILE_MAX} character(s)"))
             .when(~F.regexp_like(n, F.lit(FEED_FILE_PATTERN)),
                   F.lit("sourceFile: sourceFile must be a *.csv filename, no path components")))


def vendor_id_error(v) -> Column:
    c = _c(v)
    return (F.when(c.isNull(), F.lit("vendorId: Required"))
             .when(F.length(c) < 1, F.lit("vendorId: String must contain at least 1 character(s)"))
             .when(F.length(c) > VENDOR_ID_MAX,
                   F.lit(f"vendorId: String must contain at most {VENDOR_ID_MAX} character(s)")))


def product_cache_key(id_col) -> Column:
    """``product:{id}``."""
    return F.concat(F.lit(PRODUCT_KEY_PREFIX), _c(id_col).cast("string"))


def list_namespace_key(category_id) -> Column:
    """``products:list:cat={id or all}``."""
    return F.concat(F.lit("products:list:cat="), F.coalesce(_c(category_id).cast("string"), F.lit("all")))


def resource_of(key) -> Column:
    """Resource label from the key prefix."""
    return F.when(_c(key).startswith(PRODUCT_KEY_PREFIX), F.lit(RESOURCE_PRODUCT)).otherwise(
        F.lit(RESOURCE_OTHER))
