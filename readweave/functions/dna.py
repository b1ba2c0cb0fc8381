"""Sequence and CIGAR expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column, lower_too: bool = False) -> Column:
    """Reverse complement; ``lower_too`` also maps acgt, to upper case."""
    if lower_too:
        return F.reverse(F.translate(seq, "ACGTacgt", "TGCATGCA"))
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def padded_slice(seq: Column, start: Column, length: Column) -> Column:
    """``length`` bases from 0-based ``start``; positions outside the sequence read N."""
    total = F.length(seq)
    left = F.least(F.greatest(-start, F.lit(0)), length)
    begin = F.greatest(start, F.lit(0))
    body = F.greatest(F.least(start + length, total) - begin, F.lit(0))
    right = length - left - body
    pad = F.lit("N")
    return F.concat(
        F.repeat(pad, left.cast("int")),
        F.substring(seq, begin.cast("int") + 1, body.cast("int")),
        F.repeat(pad, right.cast("int")),
    )


def cigar_ops(cigar: Column) -> Column:
    """Array of (n, op) structs."""
    counts = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHPX=B])"), F.lit(1))
    letters = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHPX=B])"), F.lit(2))
    return F.zip_with(counts, letters, lambda n, op: F.struct(n.cast("int").alias("n"), op.alias("op")))


def cigar_reference_span(cigar: Column) -> Column:
    """Bases consumed on the reference: M D N = X forward, B backward."""
    return F.aggregate(
        cigar_ops(cigar),
        F.lit(0),
        lambda acc, c: acc + F.when(c["op"].isin("M", "D", "N", "=", "X"), c["n"]).when(c["op"] == "B", -c["n"]).otherwise(0),
    )


def cigar_end(pos: Column, cigar: Column) -> Column:
    """0-based exclusive end of an alignment."""
    return pos + cigar_reference_span(cigar)


def cigar_del_minus_ins(cigar: Column) -> Column:
    change = F.aggregate(
        cigar_ops(cigar),
        F.lit(0),
        lambda acc, c: acc + F.when(c["op"] == "D", c["n"]).when(c["op"] == "I", -c["n"]).otherwise(0),
    )
    # most have neither, and need no list of operations
    return F.when(cigar.contains("D") | cigar.contains("I"), change).when(cigar.isNotNull(), 0)


def flag_set(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


# Alignment flag bits
PAIRED, PROPER_PAIR, UNMAP, MUNMAP, REVERSE, READ1, READ2 = 1, 2, 4, 8, 16, 64, 128
