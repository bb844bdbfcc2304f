"""Fingerprints in pieces, and a manifest that outlives the files it describes."""

from __future__ import annotations

import hashlib

from factorloom.plans import catalogue, registry  # noqa: F401
from factorloom.sources import digests

DATA = "/root/testdata/sf0.001"


def states(df):
    return {r.name: r.state for r in df.collect()}


def test_states_against_a_stored_manifest(spark, tmp_path):
    folder, manifest = tmp_path / "files", f"file://{tmp_path}/manifest"
    folder.mkdir()
    for name, size in (("a.bin", 0), ("b.bin", 5), ("c d.bin", 100_000), ("e.bin", 1)):
        (folder / name).write_bytes(b"x" * size)
    assert set(states(digests.checked(spark, str(folder), manifest)).values()) == {"new"}
    assert set(states(digests.checked(spark, str(folder), manifest)).values()) == {"same"}
    (folder / "b.bin").write_bytes(b"y" * 5)
    (folder / "e.bin").unlink()
    (folder / "f.bin").write_bytes(b"")
    assert states(digests.checked(spark, str(folder), manifest)) == {"a.bin": "same", "b.bin": "changed", "c d.bin": "same", "e.bin": "missing", "f.bin": "new"}


def test_digest_of_pieces_is_that_of_the_file(spark, tmp_path):
    data = bytes(range(256)) * 5_000
    (tmp_path / "big.bin").write_bytes(data)
    row = digests.fingerprints(spark, str(tmp_path), "*.bin", piece=1_000).first()
    assert (row.name, row.bytes, row.sha256) == ("big.bin", len(data), hashlib.sha256(data).hexdigest())


def test_the_query_compares_with_its_first_run(spark):
    first, second = (states(registry.QUERIES["S16_fingerprint"](spark, DATA)) for _ in range(2))
    assert len(first) > 5 and set(second.values()) == {"same"} and set(first) == set(second)
