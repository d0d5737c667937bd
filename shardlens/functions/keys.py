"""Column expressions over object keys `name/data_type/language/md5.zz`."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shardlens.schemas import KEY_SEPARATOR, KEY_SUFFIX

KEY_FIELDS = ["name", "data_type", "language", "md5"]


def key_part(key: Column | str, place: int) -> Column:
    """Part `place` (from 1) of a key that has that many parts; empty parts count."""
    return F.substring_index(F.substring_index(key, KEY_SEPARATOR, place), KEY_SEPARATOR, -1)


def is_valid_key(key: Column | str) -> Column:
    """A key needs at least four parts. Further parts are ignored."""
    whole = F.col(key) if isinstance(key, str) else key
    fewer = len(KEY_FIELDS) - 1
    return F.coalesce(F.substring_index(whole, KEY_SEPARATOR, fewer) != whole, F.lit(False))


def key_fields(key: Column | str) -> list[Column]:
    """name, data_type, language and md5 of a valid key.

    The suffix is taken out wherever it occurs in the fourth part.
    """
    name, data_type, language, last = (key_part(key, i) for i in range(1, 5))
    md5 = F.replace(last, F.lit(KEY_SUFFIX), F.lit(""))
    return [
        name.alias("name"),
        data_type.alias("data_type"),
        language.alias("language"),
        md5.alias("md5"),
    ]


def object_key() -> Column:
    """The key a catalogue row stands for."""
    return F.concat(F.concat_ws(KEY_SEPARATOR, *KEY_FIELDS), F.lit(KEY_SUFFIX))


def load_prefix(name: Column | str, data_type: Column | str) -> Column:
    """Prefix of one load. No trailing separator, so `a/text` also covers `a/text2`."""
    return F.concat_ws(KEY_SEPARATOR, name, data_type)
