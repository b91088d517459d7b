"""Column functions: derived amounts, occupancy, names, units, time buckets, shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEI = "decimal(38,0)"


def share(part: Column, whole: Column) -> Column:
    """Percentage with six places; 0 where there is nothing to share."""
    return F.coalesce(F.round(F.try_divide(part.cast("double") * 100, whole.cast("double")), 6), F.lit(0.0))


def slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


def present(text: Column) -> Column:
    """The trimmed text, or null if nothing is left."""
    return F.nullif(F.btrim(text), F.lit(""))


def bucket(t: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket of an epoch second."""
    return t - F.pmod(t, F.lit(seconds))


def headroom(cap: Column, fee: Column) -> Column:
    """What a cap leaves above the fee, at least 0; null if either is unknown."""
    return F.when(cap.isNotNull() & fee.isNotNull(), F.greatest(cap - fee, F.lit(0)))


def effective_tip(tip: Column, cap: Column, base: Column) -> Column:
    """max(0, min(tip, cap - base)), null if an input is unknown."""
    return F.when(tip.isNotNull() & cap.isNotNull() & base.isNotNull(), F.greatest(F.lit(0), F.least(tip, cap - base)))


def units(wei: Column, places: int) -> Column:
    """Exact decimal text of an integer amount of the smallest unit, without trailing zeros; anything but
    an optional minus and digits gives the empty text."""
    text = F.btrim(wei.cast("string"))
    bare = F.regexp_replace(text, "^-?0*(?=[0-9])", "")
    digits = F.lpad(bare, F.greatest(F.length(bare), F.lit(places + 1)), F.lit("0"))
    whole = F.substring(digits, F.lit(1), F.length(digits) - places)
    rest = F.rtrim(F.substring(digits, F.length(digits) - places + 1, F.lit(places)), F.lit("0"))
    number = F.when(rest == "", whole).otherwise(F.concat(whole, F.lit("."), rest))
    signed = F.when(text.startswith("-") & (number != "0"), F.concat(F.lit("-"), number)).otherwise(number)
    return F.when(F.rlike(text, F.lit("^-?[0-9]+$")), signed).otherwise("")


def slot(t: Column, genesis: int, seconds: int, stored: Column | None = None) -> Column:
    """Number of the slot of a time, null before genesis; a stored number wins."""
    own = F.when(t >= genesis, F.floor((t - genesis) / seconds).cast("long"))
    return own if stored is None else F.coalesce(stored, own)


def first_positive(*values: Column) -> Column:
    """The first value above 0, else 0."""
    return F.coalesce(*(F.when(v > 0, v) for v in values), F.lit(0)).cast("long")


def percent_text(part: Column, whole: Column) -> Column:
    """part / whole in percent as text with six places, rounded half away from zero in whole numbers; null
    where the whole is 0 or unknown."""
    wide = "decimal(38,0)"
    twice = (F.abs(part).cast("decimal(28,0)") * F.lit(2 * 10**8).cast("decimal(9,0)")).cast(wide) + whole.cast(wide)
    below = (whole.cast("decimal(37,0)") * F.lit(2).cast("decimal(1,0)")).cast(wide)
    q = F.floor(twice.cast(wide) / F.nullif(below, F.lit(0).cast(wide))).cast("long")
    text = F.concat(F.when(part < 0, "-").otherwise(""), F.floor(q / 1_000_000).cast("string"), F.lit("."), F.lpad((q % 1_000_000).cast("string"), 6, "0"))
    return F.when(whole > 0, text)


def extra_bytes(extra: Column) -> Column:
    """Bytes of a hex text as characters 0 to 255, or null if it is none."""
    bare = F.regexp_replace(extra, "^0[xX]", "")
    return F.when(F.rlike(bare, F.lit("^([0-9a-fA-F]{2})*$")), F.decode(F.unhex(bare), "ISO-8859-1"))


def extra_text(extra: Column) -> Column:
    """The printable text of a hex text, or the empty text."""
    raw = extra_bytes(extra)
    return F.when(F.rlike(raw, F.lit(r"^[\x20-\x7e]+$")), F.btrim(raw)).otherwise("")


def short_address(address: Column) -> Column:
    return F.when(F.length(address) < 12, address).otherwise(F.concat(F.substring(address, 1, 6), F.lit("…"), F.right(address, F.lit(4))))


def dash_slug(text: Column) -> Column:
    return F.btrim(F.substring(F.ltrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, 64), F.lit("-"))


def producer_label(extra: Column, recipient: Column, known: list[tuple[str, str, str]]) -> Column:
    """struct(key, name): the first known (match, key, name) whose match is in the lower-cased bytes; else
    the printable text of three characters or more; else the recipient's address."""
    raw = F.lower(F.coalesce(extra_bytes(extra), F.lit("")))
    made = lambda key, name: F.struct(key.alias("key"), name.alias("name"))
    label = F.regexp_replace(F.coalesce(extra_bytes(extra), F.lit("")), r"^[\x00-\x20\x7f]+|[\x00-\x20\x7f]+$", "")
    label = F.when(F.rlike(label, F.lit(r"^[\x20-\x7e]{3,}$")), label).otherwise("")
    address = F.lower(F.btrim(F.coalesce(recipient, F.lit(""))))
    rules = F.when(F.lit(False), made(F.lit(""), F.lit("")))
    for match, key, name in known:
        rules = rules.when(raw.contains(match), made(F.lit(key), F.lit(name)))
    rules = rules.when(dash_slug(label) != "", made(F.concat(F.lit("extra:"), dash_slug(label)), label))
    rules = rules.when(address == "", made(F.lit("addr:unknown"), F.lit("unknown")))
    return rules.otherwise(made(F.concat(F.lit("addr:"), address), short_address(address)))


def duration(text: Column) -> Column:
    """Seconds of ``5m``, ``1h`` or ``7d``, from one minute to thirty days; else null."""
    t = F.lower(F.btrim(text))
    amount = F.when(F.rlike(t, F.lit("^[0-9]{1,9}[mhd]$")), F.regexp_extract(t, "^[0-9]+", 0)).cast("long")
    unit = F.when(F.right(t, F.lit(1)) == "m", 60).when(F.right(t, F.lit(1)) == "h", 3600).otherwise(86400)
    return F.when((amount * unit).between(60, 30 * 86400), amount * unit)


def wei_text(amount: Column) -> Column:
    return amount.cast(WEI).cast("string")
