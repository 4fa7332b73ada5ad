"""Column functions: ids, addresses, paths, times, ratios. All stay inside the JVM."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UUID_CANONICAL = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_UUID_IN_TEXT = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_uuid(c: Column | str) -> Column:
    """Lower-case hyphenated form of any accepted spelling of a UUID, NULL if it is none.

    Upper case, missing hyphens, surrounding braces and the ``urn:uuid:`` prefix name the same
    id. Ids that are already canonical skip the regex work.
    """
    c = col(c)
    bare = F.regexp_replace(c, "urn:|uuid:", "")
    bare = F.regexp_replace(bare, r"^[{}]+|[{}]+$", "")
    digits = F.lower(F.regexp_replace(bare, "-", ""))
    spelled = F.regexp_replace(
        digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", r"$1-$2-$3-$4-$5"
    )
    return F.when(c.rlike(_UUID_CANONICAL), c).when(digits.rlike("^[0-9a-f]{32}$"), spelled)


def hash_ip(c: Column | str) -> Column:
    """SHA-256 hex of an address; NULL for a missing or empty one."""
    c = col(c)
    return F.when(c != "", F.sha2(c, 256))


def client_ip(forwarded: Column | str, peer: Column | str) -> Column:
    """First entry of the forwarded list, else the peer address, else ``unknown``."""
    forwarded, peer = col(forwarded), col(peer)
    first = F.regexp_replace(F.split_part(forwarded, F.lit(","), F.lit(1)), r"^\s+|\s+$", "")
    return F.when(forwarded != "", first).otherwise(F.coalesce(peer, F.lit("unknown")))


def normalize_path(c: Column | str, max_chars: int = 120) -> Column:
    """Replace ids in a request path by ``{id}`` so that it can be a group key."""
    path = F.regexp_replace(col(c), _UUID_IN_TEXT, "{id}")
    return F.substring(F.regexp_replace(path, r"/\p{Nd}+", "/{id}"), 1, max_chars)


_ISO_COMMON = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})?$"
)
# date, hour, minute, second, fraction, zone; separators optional, any one character between
# date and time
_ISO_ANY = (
    r"^(\d{4})-?(\d{2})-?(\d{2})"
    r"(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
    r"(?:(Z)|([+-]\d{2})(?::?(\d{2}))?)?)?$"
)


def parse_client_ts(c: Column | str) -> Column:
    """ISO-8601 text as a timestamp, NULL if it is not one. Text without a zone is UTC."""
    c = col(c)

    def part(i: int, default: str) -> Column:
        text = F.regexp_extract(c, _ISO_ANY, i)
        return F.when(text == "", F.lit(default)).otherwise(text)

    zone = F.when(F.regexp_extract(c, _ISO_ANY, 9) != "",
                  F.concat(part(9, ""), F.lit(":"), part(10, "00"))).otherwise(F.lit("Z"))
    spelled = F.concat(
        part(1, ""), F.lit("-"), part(2, ""), F.lit("-"), part(3, ""), F.lit("T"),
        part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), F.lit("."),
        part(7, "0"), zone,
    )
    return (
        F.when(c.rlike(_ISO_COMMON), c.try_cast("timestamp"))
        .when(c.rlike(_ISO_ANY), spelled.try_cast("timestamp"))
    )


def uuid_of(text: Column) -> Column:
    """An id that depends on the text alone, in the form of a UUID; NULL for NULL."""
    return F.regexp_replace(F.md5(text), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$",
                            "$1-$2-3$3-8$4-$5")


def utc_day(ts: Column | str) -> Column:
    """The UTC calendar day of a timestamp (the session zone is UTC)."""
    return F.to_date(col(ts))


def epoch_ms(ts: Column | str) -> Column:
    return F.unix_millis(col(ts).cast("timestamp"))


def ratio_1e4(part: Column, whole: Column) -> Column:
    """``part / whole`` in ten-thousandths, rounded half up with integers; NULL if whole is 0.

    Integer arithmetic gives the same digits on every engine, unlike rounding a double.
    """
    part, whole = part.cast("bigint"), whole.cast("bigint")
    return F.when(whole > 0, F.call_function("div", part * 20_000 + whole, whole * 2))


def ratio_double(part: Column, whole: Column) -> Column:
    return ratio_1e4(part, whole) / F.lit(10_000.0)


def rate_decimal(part: Column, whole: Column) -> Column:
    """Ratio as DECIMAL(8,4), 0 when the whole is empty."""
    scaled = F.coalesce(ratio_1e4(part, whole), F.lit(0)).cast("decimal(12,0)")
    return (scaled * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(8,4)")


def at(as_of) -> Column:
    """A reference time given as a literal, a column, or a one-row, one-column DataFrame."""
    if isinstance(as_of, Column):
        return as_of
    if hasattr(as_of, "scalar"):
        return as_of.scalar()
    return F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else F.lit(as_of)


def before(as_of, amount: int, unit: str) -> Column:
    """``as_of`` minus a fixed span; unit is one of days, hours, secs."""
    return at(as_of) - F.make_dt_interval(**{unit: F.lit(amount)})


def evaluated_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns whose expressions are too large to be repeated.

    The optimizer copies a projected expression into every filter and projection above it, but
    not what a generator makes. Filters on the other columns pass a generator and reach the scan.
    The outer form, since for the other one the optimizer adds a filter on the array's size, which
    evaluates all expressions down to the scan a second time.
    """
    made = F.struct(*[e.alias(f"_once_{i}") for i, e in enumerate(columns.values())])
    out = df.select("*", F.array(made).alias("_once")).select(*df.columns, F.inline_outer("_once"))
    place = {n: F.col(f"_once_{i}") for i, n in enumerate(columns)}
    return out.select(*[place.pop(c).alias(c) if c in place else F.col(c) for c in df.columns],
                      *[e.alias(n) for n, e in list(place.items())])
