"""Integer samples: gain, channels, discontinuities, and the header of WAV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def amplify(x: Column, factor: int, bits: int = 16) -> Column:
    """Signed samples times a factor, saturating."""
    return F.greatest(F.least(x.cast("long") * factor, F.lit((1 << (bits - 1)) - 1)), F.lit(-(1 << (bits - 1))))


def to_mono(left: Column, right: Column) -> Column:
    """The floor of the mean."""
    return F.shiftright(left.cast("long") + right.cast("long"), 1)


def discontinuities(x: Column, threshold: int, key: str, order: str) -> Column:
    """Samples that differ from the one before by at least a threshold; the first is never one."""
    return F.coalesce(F.abs(x - F.lag(x).over(Window.partitionBy(key).orderBy(order))) >= threshold, F.lit(False))


def interleave(*channels: Column) -> Column:
    """Arrays of equal length as one array, sample by sample."""
    return F.flatten(F.transform(F.arrays_zip(*(c.alias(f"c{n}") for n, c in enumerate(channels))), lambda z: F.array(*(z[f"c{n}"] for n in range(len(channels))))))


def channel(samples: Column, number: int, of: int) -> Column:
    """One channel of interleaved samples."""
    return F.filter(samples, lambda x, i: F.pmod(i, F.lit(of)) == number)


def wav_header(df: DataFrame, content: str = "content") -> DataFrame:
    """channels, sample_rate, bits, data_bytes of WAV files with a plain 44-byte header."""

    def number(at: int, size: int) -> Column:
        part = F.hex(F.substring(content, at + 1, size))
        turned = F.array_join(F.reverse(F.regexp_extract_all(part, F.lit(".."), F.lit(0))), "")
        return F.conv(turned, 16, 10).cast("long")

    is_wav = (F.substring(content, 1, 4) == F.lit(b"RIFF")) & (F.substring(content, 9, 4) == F.lit(b"WAVE"))
    made = {"channels": number(22, 2), "sample_rate": number(24, 4), "bits": number(34, 2), "data_bytes": number(40, 4)}
    return df.withColumns({name: F.when(is_wav, c) for name, c in made.items()})


def wav_samples(content: Column, bits: int = 16) -> Column:
    """The samples of a WAV file's data: unsigned for 8 bits, else signed, little end first."""
    size = bits // 8
    words = F.regexp_extract_all(F.hex(F.substring(content, F.lit(45), F.octet_length(content) - 44)), F.lit("." * (2 * size)), F.lit(0))
    turned = F.transform(words, lambda w: F.conv(F.array_join(F.reverse(F.regexp_extract_all(w, F.lit(".."), F.lit(0))), ""), 16, 10).cast("long"))
    return turned if bits == 8 else F.transform(turned, lambda v: F.when(v >= (1 << (bits - 1)), v - (1 << bits)).otherwise(v))
