"""Scalar functions on columns: cleaning, identifiers, sequences, classifications."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[\s\x{00A0}]+|[\s\x{00A0}]+$"


def text(c: Column) -> Column:
    """Trimmed of all white space; null and 'nan' are empty."""
    out = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), _EDGE, "")
    return F.when(F.lower(out) == "nan", "").otherwise(out)


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(c: Column) -> Column:
    """Finite double or null."""
    v = F.when(text(c).rlike(_NUMBER), text(c)).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def integer(c: Column, mode: str = "ingest") -> Column:
    """Whole number or null. ``ingest`` strips commas and blanks, ``plain`` doesn't, ``strict`` fails on anything that isn't whole."""
    if mode not in ("ingest", "plain", "strict"):
        raise ValueError(mode)
    raw = F.regexp_replace(text(c), r"[,\s\x{00A0}]", "") if mode == "ingest" else text(c)
    v = F.when(raw.rlike(_NUMBER), raw).try_cast("double")
    whole = F.when(raw.rlike("^[+-]?[0-9]{1,15}$"), raw.try_cast("long")).when(v == F.rint(v), v.try_cast("long"))
    if mode == "strict":
        return F.when((raw != "") & whole.isNull(), F.raise_error(F.concat(F.lit("not an integer: "), raw)).cast("long")).otherwise(whole)
    return whole


def strict_boolean(c: Column) -> Column:
    s = F.lower(text(c))
    return F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), s)).cast("boolean"))


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def chromosome(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Alias, else the number behind a word 'chr' or 'chromosome' anywhere in the text, else a bare whole number, else the text; accession versions stay as they are."""
    s = text(c)
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in (aliases or {"": ""}).items() for x in kv]), s)
    named = F.regexp_extract(s, r"(?i)(?:^|[_\s])(?:chromosome|chr)[_\s-]*(\d+)(?:\b|_)", 1)
    digits = F.regexp_extract(s, r"^(\d+)(?:\.0+)?$", 1)
    plain = F.regexp_replace(F.coalesce(F.nullif(named, F.lit("")), F.nullif(digits, F.lit(""))), r"^0+(?=\d)", "")
    return F.coalesce(known, plain, s)


def canonical_marker(c: Column) -> Column:
    """number.F.zero.offset, and number|f|zero--offset, become number|F|zero--offset, for F and R in either case; anything else is unchanged."""
    s = text(c)
    parts = F.regexp_extract_all(s, F.lit(r"^(\d+)(?:\.([FRfr])\.(\d+)\.|\|([FRfr])\|(\d+)--)(\d+)$"), F.lit(0))
    at = lambda i: F.regexp_extract(s, r"^(\d+)(?:\.|\|)([FRfr])(?:\.|\|)(\d+)(?:\.|--)(\d+)$", i)
    return F.when(F.size(parts) == 1, F.concat(at(1), F.lit("|"), F.upper(at(2)), F.lit("|"), at(3), F.lit("--"), at(4))).otherwise(s)


def dart_suffix(c: Column) -> Column:
    return F.regexp_extract(c, r"--(\d+)$", 1).try_cast("long")


def tag_family(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^(.*)--[0-9]+$", 1), F.lit("")), c)


def lexical_trait(c: Column) -> Column:
    """White space before a closing _UR or _R goes."""
    return F.regexp_replace(text(c), r"\s*_\s*(UR|R)$", "_$1")


def stable_id(*columns: Column, width: int = 16) -> Column:
    """First hex digits of the sha256 of the values, null as empty, parted by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256), 1, width)


def dna(c: Column) -> Column:
    """Upper case without blanks; null unless all of it is A, C, G or T."""
    s = F.upper(F.regexp_replace(c, r"\s", ""))
    return F.when(s.rlike("^[ACGT]+$"), s)


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGTN", "TGCAN"))


def reconstruct(five: Column, variation: Column, three: Column) -> tuple[Column, Column]:
    """Tags of the first and the second allele."""
    ok = variation.rlike("^[ACGT]>[ACGT]$")
    return tuple(F.when(ok, F.concat(five, F.substring(variation, at, 1), three)) for at in (1, 3))


def compare_tag(name: Column, copies: Column, ref: Column, alt: Column, sequence: Column) -> Column:
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "missing_reference_name").when(copies > 1, "duplicate_reference_name")
        .when(ref.isNull() | alt.isNull(), "unsupported_flank_or_variation").when(sequence.isNull(), "unsupported_reference_sequence")
        .when(sequence == ref, "exact_ref_tag").when(sequence == alt, "exact_alt_tag")
        .when(sequence == reverse_complement(ref), "reverse_complement_ref_tag").when(sequence == reverse_complement(alt), "reverse_complement_alt_tag")
        .otherwise("sequence_mismatch")
    )


def positional_models(position: Column, offset: Column, length: Column) -> Column:
    """Where a tag begins if the position is its own or its variant's, counted from one or zero, on either strand."""
    last = length - 1 - offset
    names = {"tag_start_1based": position, "tag_start_0based": position + 1, "snp_1based_forward": position - offset, "snp_0based_forward": position + 1 - offset, "snp_1based_reverse": position - last, "snp_0based_reverse": position + 1 - last, "tag_end_1based": position - length + 1}
    return F.array(*[F.struct(F.lit(k).alias("model"), v.cast("long").alias("start")) for k, v in names.items()])


def coordinate_relation(ca: Column, pa: Column, cb: Column, pb: Column) -> Column:
    gone = ca.isNull() | pa.isNull() | cb.isNull() | pb.isNull()
    return F.when(gone, "unavailable").when(ca != cb, "different_chromosomes").when(pa == pb, "exact_coordinate").otherwise("same_chromosome_offset")


def interval_state(peak: Column, start: Column, end: Column) -> Column:
    return (
        F.when(F.coalesce(peak, F.lit(0)) <= 0, "invalid_peak").when(start.isNull() & end.isNull(), "no_boundaries").when(start.isNull() | end.isNull(), "partial_boundaries")
        .when((start <= 0) | (end <= 0), "nonpositive_boundary").when(start > end, "reversed_boundaries").when((peak < start) | (peak > end), "peak_outside_interval").otherwise("valid_as_labeled")
    )


def boundary_rotation(fields: list[Column], wanted: list[Column]) -> Column:
    """The first reordering of three fields that equals the wanted ones, as text, or null."""
    out = F.lit(None).cast("string")
    for order in reversed(list(permutations(range(3)))):
        same = fields[order[0]].eqNullSafe(wanted[0]) & fields[order[1]].eqNullSafe(wanted[1]) & fields[order[2]].eqNullSafe(wanted[2])
        out = F.when(same, "".join(map(str, order))).otherwise(out)
    return out


def close(a: Column, b: Column, rtol: float = 1e-12) -> Column:
    return F.coalesce(F.abs(a - b) <= rtol * F.greatest(F.abs(a), F.abs(b)), a.isNull() & b.isNull())


def scalar_comparison(a: Column, b: Column, factors: tuple[int, ...] = (100, 1000)) -> Column:
    """equal, scale_factor_N, different, or missing; the factor is reported, never applied."""
    out = F.when(a.isNull() | b.isNull(), "missing").when(close(a, b), "equal")
    for f in factors:
        out = out.when(close(a, b * f) | close(a * f, b), f"scale_factor_{f}")
    return out.otherwise("different")


def interpret_symbol(c: Column) -> Column:
    """Base states of a nucleotide code; null if it is none."""
    # Nucleotide ambiguity codes.
    codes = {"A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT"}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), c)


def same_value(a: Column, b: Column, kind: str, tolerance: float = 1e-12) -> Column:
    """Typed equality: null equals only null; doubles within an absolute and relative tolerance, all else exactly."""
    if kind in ("double", "float"):
        near = F.abs(a - b) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs(a), F.abs(b)))
        return F.coalesce(near, F.lit(False)) | (a.isNull() & b.isNull())
    return a.eqNullSafe(b)


def gff_attributes(c: Column) -> Column:
    """Attribute map with percent decoding; of a repeated key the last value counts."""
    parts = F.filter(F.transform(F.split(c, ";"), lambda p: F.split(p, "=", 2)), lambda p: F.size(p) == 2)
    decode = lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)
    # From the back, the first place of a key is its last.
    pairs = F.reverse(F.transform(parts, lambda p: F.struct(F.trim(p[0]).alias("k"), decode(p[1]).alias("v"))))
    names = F.transform(pairs, lambda p: p["k"])
    once = F.array_distinct(names)
    return F.map_from_arrays(once, F.transform(once, lambda n: F.element_at(pairs, F.array_position(names, n).cast("int"))["v"]))
