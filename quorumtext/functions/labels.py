"""Small classifiers and formatters: slugs, failure reasons, buckets, hashes, lenient JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket names, rest times in seconds, magic bytes and reject limits.
AGREEMENT_BUCKETS = ("all agree (1.0)", "most agree (0.67-0.99)", "half agree (0.50-0.66)", "few agree (<0.50)")
WEAKEST_BUCKETS = ("all agree (1.0)", "most (0.67-0.99)", "half (0.5-0.66)", "few (<0.5)")
QUOTA_REST, UPSTREAM_REST, DAY_REST, AUTH_REST = 3600, 300, 6 * 3600, 3600
HEIC_BRANDS = ("heic", "heix", "hevc", "mif1", "msf1", "heif")


def writer_slug(name: Column) -> Column:
    """File-safe writer id; null when nothing but underscores is left."""
    slug = F.substring(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_-]", "_"), 1, 64)
    return F.when(F.regexp_replace(slug, "_", "") != "", slug)


def model_label(name: Column) -> Column:
    """``provider:path/model:free`` -> ``model (provider)``."""
    provider = F.split_part(name, F.lit(":"), F.lit(1))
    rest = F.regexp_replace(F.regexp_replace(name, "^[^:]*:?", ""), ":free$", "")
    leaf = F.element_at(F.split(rest, "/"), -1)
    return F.when(rest == "", provider).otherwise(F.concat(leaf, F.lit(" ("), provider, F.lit(")")))


def base_name(name: Column, fallback: str = "transcription") -> Column:
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    slug = F.substring(F.regexp_replace(stem, r"[^A-Za-z0-9_.-]+", "-"), 1, 60)
    return F.when(slug == "", fallback).otherwise(slug)


def fail_reason(error: Column) -> Column:
    x = F.lower(error)
    return (
        F.when(x.rlike("translat"), "translated")
        .when(x.rlike("429|quota|rate.?limit|too many"), "busy")
        .when(x.rlike("timeout|timed out|no answer within"), "slow")
        .when(x.rlike("401|403|api key|not set"), "key")
        .otherwise("other")
    )


def _squash(message: Column) -> Column:
    return F.regexp_replace(F.lower(message), r"[-_\s]+", "")


def out_of_quota(status: Column, message: Column) -> Column:
    """Daily quota gone or model removed."""
    s = F.coalesce(status, F.lit(0))
    return (s == 404) | ((s == 429) & _squash(message).contains("perday"))


def upstream_down(status: Column, message: Column) -> Column:
    return ~out_of_quota(status, message) & F.lower(message).contains("provider returned error")


def key_problem(status: Column, message: Column) -> Column:
    """Class of a failed call: upstream, day_quota, minute_quota, auth or other."""
    msg = _squash(message)
    s = F.coalesce(status, F.lit(0))
    return (
        F.when((s == 429) & (msg.contains("upstream") | msg.contains("providerreturnederror")), "upstream")
        .when((s == 429) & msg.contains("perday"), "day_quota")
        .when(s == 429, "minute_quota")
        .when(s.isin(401, 403), "auth")
        .otherwise("other")
    )


def key_rest_seconds(problem: Column) -> Column:
    """Seconds the key rests; 0 = try the next key now, -1 = not a key problem."""
    return (
        F.when(problem == "day_quota", DAY_REST)
        .when(problem == "auth", AUTH_REST)
        .when(problem == "minute_quota", 0)
        .otherwise(-1)
    )


def agreement_bucket(conf: Column) -> Column:
    a, b, c, d = AGREEMENT_BUCKETS
    return F.when(conf >= 0.999, a).when(conf >= 0.665, b).when(conf >= 0.5, c).otherwise(d)


def weakest_bucket(conf: Column) -> Column:
    a, b, c, d = WEAKEST_BUCKETS
    return F.when(conf >= 0.999, a).when(conf >= 0.67, b).when(conf >= 0.5, c).otherwise(d)


def percent(part: Column, whole: Column) -> Column:
    """``12.3%`` or ``n/a``."""
    share = F.try_divide(F.lit(100.0) * part, whole)
    return F.when(whole == 0, "n/a").otherwise(F.concat(F.format_string("%.1f", share), F.lit("%")))


def short_number(x: Column) -> Column:
    """As printf's ``%g``: six significant digits without trailing zeros, with an exponent from a million on."""
    size = F.abs(x.cast("double"))
    power = F.floor(F.log10(size)).cast("int")
    six = F.bround(F.when(power > 5, size / F.pow(F.lit(10.0), power - 5)).otherwise(size * F.pow(F.lit(10.0), 5 - power))).cast("bigint").cast("string")
    power = power + F.length(six) - 6  # 999999.7 has one digit more when rounded
    digits = F.regexp_replace(six, "0+$", "")
    rest = digits.substr(F.lit(2), F.length(digits))
    exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    plain = (
        F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        .when(F.length(digits) <= power + 1, F.rpad(digits, power + 1, F.lit("0")))
        .otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), digits.substr(power + 2, F.length(digits))))
    )
    short = F.when(
        (power < -4) | (power > 5), F.concat(F.substring(digits, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), exponent)
    ).otherwise(plain)
    return F.when(size == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), short))


def hash_split(stem: Column) -> Column:
    """Fixed dev/test side: the 256-bit digest modulo 10, test below 4.  16^k is 6 modulo 10 for k >= 1."""
    h = F.sha2(stem, 256)
    total = F.aggregate(
        F.filter(F.split(F.substring(h, 1, 63), ""), lambda d: d != ""),
        F.lit(0),
        lambda acc, d: acc + F.conv(d, 16, 10).cast("int"),
    )
    last = F.conv(F.substring(h, 64, 1), 16, 10).cast("int")
    return F.when((6 * total + last) % 10 < 4, "test").otherwise("dev")


def lenient_json(text: Column) -> Column:
    """The JSON object inside a chatty answer, or null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```", ""), r"```$", ""))
    bare = F.trim(F.regexp_replace(bare, "^json", ""))
    span = F.regexp_extract(bare, r"(?s)\{.*\}", 0)

    def parsed(c: Column) -> Column:
        return F.when(F.try_parse_json(c).isNotNull(), c)

    return F.coalesce(parsed(bare), parsed(span))


def sniff_kind(content: Column) -> Column:
    """File kind from the first bytes only; ``content`` is binary."""
    head = F.hex(F.substring(content, 1, 12))
    brands = [b.encode().hex().upper() for b in HEIC_BRANDS]
    return (
        F.when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
        .when(head.startswith("255044462D"), "pdf")
        .when((F.substring(head, 9, 8) == "66747970") & F.substring(head, 17, 8).isin(*brands), "heic")
    )


def reject_code(content: Column, max_mb: float) -> Column:
    """Why an image upload is refused, null when it is fine."""
    size = F.octet_length(content)
    kind = sniff_kind(content)
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty_file")
        .when(size > int(max_mb * 1024 * 1024), "too_large")
        .when(kind == "heic", "heic_unsupported")
        .when(kind.isNull(), "unsupported_type")
    )


def bit_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def gradient_bits(vec: Column, bits: int) -> Column:
    """Hash of a vector: bit i says whether the right neighbour is larger; a 64th bit is the sign of v[0]."""
    steps = min(bits, 63)

    def add(acc: Column, i: Column) -> Column:
        bit = F.when(F.get(vec, i + 1) > F.get(vec, i), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        return F.shiftleft(acc, 1).bitwiseOR(bit)

    h = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0).cast("bigint"), add)
    if bits == 64:
        h = F.shiftleft(h, 1).bitwiseOR(F.when(F.get(vec, 0) > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    return h


def day_bucket(ts: Column, now: Column) -> Column:
    today = F.date_trunc("day", now)
    return (
        F.when(ts >= today, "today")
        .when(ts >= today - F.expr("INTERVAL 1 DAY"), "yesterday")
        .otherwise("earlier")
    )
