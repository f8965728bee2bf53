"""Typed identities: digests, DNS names, IPv4, URIs, issuer and serial, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pivotloom.functions.status import NO, UNRESOLVED, UNSUPPORTED, YES

# Hex lengths of digests.
DIGEST_LENGTHS = {"md5": 32, "sha1": 40, "sha256": 64, "sha384": 96, "sha512": 128}
# Fixed value: the split of a URI in scheme, authority, path, query and fragment.
URI = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def digest(value: Column, kind: str) -> Column:
    """Lower-cased hex of the right length, else null."""
    return F.when(value.rlike(f"^[0-9A-Fa-f]{{{DIGEST_LENGTHS[kind]}}}$"), F.lower(value))


def compare(kind_a: Column, recipe_a: Column, value_a: Column, kind_b: Column, recipe_b: Column, value_b: Column) -> Column:
    """Another kind never matches; another recipe, or a missing value, leaves it open."""
    return F.when(kind_a != kind_b, NO).when((recipe_a != recipe_b) | value_a.isNull() | value_b.isNull(), UNRESOLVED).when(value_a == value_b, YES).otherwise(NO)


def dns_name(value: Column) -> Column:
    """Lower case without the root dot; null for what is no host name."""
    name = F.lower(F.regexp_replace(value, r"\.$", ""))
    good = (F.length(name).between(1, 253)) & F.forall(F.split(name, r"\."), lambda l: l.rlike("^[a-z0-9_]([a-z0-9_-]{0,61}[a-z0-9_])?$"))
    return F.when(good & ~name.rlike(r"^[0-9.]+$"), name)


def ipv4(value: Column) -> Column:
    """The address as a number; null unless strict dotted decimal."""
    parts = F.split(value, r"\.")
    good = value.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + F.coalesce(p.try_cast("long"), F.lit(0)))
    return F.when(good & F.forall(parts, lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False))), number)


def cidr(value: Column) -> Column:
    """struct<first, last> of a prefix; null if malformed or with host bits."""
    base, bits = ipv4(F.substring_index(value, "/", 1)), F.substring_index(value, "/", -1).try_cast("int")
    size = F.pow(F.lit(2.0), 32 - bits).cast("long")
    return F.when(base.isNotNull() & bits.between(0, 32) & (F.instr(value, "/") > 0) & (base % size == 0), F.struct(base.alias("first"), (base + size - 1).alias("last")))


def uri_parts(value: Column) -> Column:
    """Parts of a URI; an absent part is null, an empty one is empty."""
    has = lambda mark: F.instr(value, mark) > 0
    part = lambda i: F.regexp_extract(value, URI, i)
    before_fragment = F.substring_index(value, "#", 1)
    return F.struct(
        F.when(part(1) != "", part(1)).alias("scheme"),
        F.when(value.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"), part(2)).alias("authority"),
        part(3).alias("path"),
        F.when(F.instr(before_fragment, "?") > 0, part(4)).alias("query"),
        F.when(has("#"), part(5)).alias("fragment"),
    )


def authority_host(authority: Column) -> Column:
    """The host of an authority, without user and port."""
    rest = F.regexp_replace(authority, "^[^@]*@", "")
    return F.when(F.startswith(rest, F.lit("[")), F.regexp_extract(rest, r"^\[[^\]]*\]", 0)).otherwise(F.regexp_replace(rest, r":\d*$", ""))


def host_kind(authority: Column) -> Column:
    """none, ipv6, ipvfuture, ipv4, dns or reg_name."""
    host = authority_host(authority)
    return (
        F.when(host.isNull() | (host == ""), "none").when(host.rlike(r"^\[v"), "ipvfuture").when(F.startswith(host, F.lit("[")), "ipv6")
        .when(ipv4(host).isNotNull(), "ipv4").when(dns_name(host).isNotNull(), "dns").otherwise("reg_name")
    )


def suffixes(name: Column) -> Column:
    """A DNS name and all its parents."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def serial_hex(value: Column, radix: int) -> Column:
    """A certificate serial as lower-case hex without leading zeros; null if it isn't a number of that radix.

    Decimal serials of any length are read three digits at a time into 24-bit limbs, the
    least first, so no number leaves 64 bits.
    """
    if radix == 16:
        text = F.when(value.rlike("^[0-9A-Fa-f]+$"), F.lower(value))
    else:
        padded = F.lpad(value, F.ceil(F.length(value) / 3).cast("int") * 3, "0")
        groups = F.regexp_extract_all(padded, F.lit("[0-9]{3}"), F.lit(0))
        limbs = F.array(F.lit(0).cast("long"))

        def times_and_add(number: Column, digits: Column) -> Column:
            start = F.struct(F.array().cast("array<bigint>").alias("out"), digits.cast("long").alias("carry"))
            done = F.aggregate(number, start, lambda s, x: F.struct(
                F.concat(s["out"], F.array((x * 1000 + s["carry"]) % (1 << 24))).alias("out"), F.floor((x * 1000 + s["carry"]) / (1 << 24)).alias("carry")))
            return F.transform(F.array(done), lambda d: F.when(d["carry"] > 0, F.concat(d["out"], F.array(d["carry"]))).otherwise(d["out"]))[0]

        number = F.aggregate(groups, limbs, times_and_add)
        text = F.when(value.rlike("^[0-9]+$"), F.array_join(F.transform(F.reverse(number), lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), ""))
    return F.regexp_replace(text, "^0+(?=.)", "")


def der_bytes(pem: Column) -> Column:
    """The DER bytes of a PEM block, or of its base64 text alone."""
    return F.unbase64(F.regexp_replace(pem, r"-----[A-Z ]+-----|\s+", ""))


def material(kind: Column, recipe: Column, content: Column) -> Column:
    """struct<kind, recipe, value>: the SHA-256 of bytes with how they were made."""
    return F.struct(kind.alias("kind"), recipe.alias("recipe"), F.sha2(content, 256).alias("value"))


def content_matches(content: Column, reported: Column, length: Column, scope: Column) -> Column:
    """Preserved bytes against a reported digest and length: a contradiction is invalid."""
    return (
        F.when(content.isNull() | reported.isNull(), UNRESOLVED).when(scope != "exact_source_bytes", UNSUPPORTED)
        .when((F.sha2(content, 256) != reported) | F.coalesce(F.octet_length(content) != length, F.lit(False)), "invalid").otherwise(YES)
    )


def equality_classes(rows: DataFrame, key: str, recipe: str, value: str) -> DataFrame:
    """Each row with its class (the smallest key of its value) and its links within it.

    `matches` counts other rows of the value and recipe, `unresolved` those of another
    recipe; copies aren't paired off.
    """
    own = rows.groupBy(value, recipe).agg(F.count(F.lit(1)).alias("_own"), F.min(key).alias("_low"))
    every = own.groupBy(value).agg(F.sum("_own").alias("_all"), F.min("_low").alias("class_id"))
    j = rows.join(own.drop("_low"), [value, recipe]).join(every, value)
    return j.withColumn("matches", F.col("_own") - 1).withColumn("unresolved", F.col("_all") - F.col("_own")).drop("_own", "_all")


def file_uuid(namespace_hex: str, name: Column) -> Column:
    """A version 5 UUID of a name in a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


# The namespace of deterministic identifiers of exported objects, as the standard
# publishes it, and the order in which it prefers hashes.
OBJECT_NAMESPACE = "00ABEDB4AA42466C9C01FED23315A9B7"
HASH_ORDER = ("MD5", "SHA-1", "SHA-256", "SHA-512")


def chosen_hash(hashes: Column) -> Column:
    """Of a map of hashes the one entry that identifies a file: the first preferred one, else the first by name; null without any."""
    kept = F.map_filter(hashes, lambda k, v: v.isNotNull())
    first = F.coalesce(*[F.when(F.map_contains_key(kept, k), F.lit(k)) for k in HASH_ORDER], F.array_min(F.map_keys(kept)))
    return F.when(first.isNotNull(), F.create_map(first, F.try_element_at(kept, first)))


def file_ref(hashes: Column, name: Column) -> Column:
    """The identifier of a file that its chosen hash and its name contribute to; null if it has neither."""
    name = F.when(F.length(name) > 0, name)
    said = F.to_json(F.struct(chosen_hash(hashes).alias("hashes"), name.alias("name")))
    return F.when(said != "{}", F.concat(F.lit("file--"), file_uuid(OBJECT_NAMESPACE, said)))
