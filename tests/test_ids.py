import re

from brookframe.functions import ids


def test_formats():
    assert re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", ids.uuid7())
    assert re.fullmatch(r"[0-9A-HJKMNP-TV-Z]{26}", ids.ulid()) and re.fullmatch(r"[\w-]{21}", ids.nanoid()) and re.fullmatch(r"[a-z][0-9a-z]{23}", ids.cuid2())
    for make in (ids.uuid4, ids.uuid7, ids.ulid, ids.nanoid, ids.cuid2):
        assert len({make() for _ in range(200)}) == 200


def test_columns(spark):
    rows = spark.range(50).select(ids.uuid4_column().alias("a"), ids.uuid7_column().alias("b")).collect()
    assert len({r.a for r in rows}) == len({r.b for r in rows}) == 50
    assert all(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", r.b) for r in rows)
