"""Token sequences: a testable tokenizer, image marks, padding, splicing and label masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The label that a loss skips, the id in an image's place, patches counted for an image.
IGNORE, IMAGE_ID, IMAGE_WORDS = -100, -200, 128
BOS = 1


def char_ids(text: Column, bos: bool = False) -> Column:
    """Code points as ids: a tokenizer whose ids any engine can make. ``bos`` puts id 1 before them."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    ids = F.transform(chars, lambda c: F.ascii(c).cast("long"))
    return F.concat(F.array(F.lit(BOS).cast("long")), ids) if bos else ids


def ids_with_images(text: Column, bos: bool = False, mark: str = "<image>") -> Column:
    """Ids of the text between image marks, with the image id at each mark and one beginning id at most."""
    parts = F.split(text, mark)
    body = F.flatten(F.transform(parts, lambda p, i: F.concat(F.when(i > 0, F.array(F.lit(IMAGE_ID).cast("long"))).otherwise(F.array().cast("array<bigint>")), char_ids(p))))
    return F.concat(F.array(F.lit(BOS).cast("long")), body) if bos else body


def pad_right(ids: Column, size: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value).cast("long"), F.greatest(size - F.size(ids), F.lit(0)).cast("int")))


def pad_left(ids: Column, size: Column, value: int) -> Column:
    return F.concat(F.array_repeat(F.lit(value).cast("long"), F.greatest(size - F.size(ids), F.lit(0)).cast("int")), ids)


def attention_mask(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: x != pad)


def unpadded(ids: Column, mask: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(ids.alias("i"), mask.alias("m")), lambda z: z["m"]), lambda z: z["i"])


def positions(length: Column, size: Column, left: bool = False) -> Column:
    """0 to length - 1 on the side without padding, 0 elsewhere."""
    run = F.when(length > 0, F.transform(F.sequence(F.lit(0), length.cast("int") - 1), lambda i: i.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return (pad_left if left else pad_right)(run, size, 0)


def spliced(ids: Column, features: int, fill: int) -> Column:
    """Each image id replaced by ``features`` values of ``fill``."""
    return F.flatten(F.transform(ids, lambda x: F.when(x == IMAGE_ID, F.array_repeat(F.lit(fill).cast("long"), features)).otherwise(F.array(x))))


def count_id(ids: Column, value: int) -> Column:
    return F.size(F.filter(ids, lambda x: x == value)).cast("long")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two id arrays."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(a, i) != F.get(b, i)))
    return F.array_min(differ).cast("long")
