"""Every message of a mail folder is in the catalogue."""

from __future__ import annotations

from quillspark.queries import QUERIES
from quillspark.sources import records as S


def test_every_message_is_in_the_catalogue(spark, tmp_path):
    """Read in several partitions, and once more from real files."""
    rows = [(c, t, "user", f"hi {c}") for c in range(60) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {f"<c{c}-{t}@example.invalid>" for c, t, *_ in rows if (c * 1000 + t) % 11}
    got = QUERIES["scan_maildir"](spark, str(tmp_path)).collect()
    assert sorted(r.message_id for r in got) == sorted(want)
    assert {r.message_id for r in QUERIES["resolve_mail"](spark, str(tmp_path)).collect()} == want | {"<none@example.invalid>"}
    folder = tmp_path / "mail" / "Inbox" / "cur"
    folder.mkdir(parents=True)
    for i in range(3):
        (folder / f"{i}").write_text(f"Message-ID: <m{i}@x>\n\nbody" if i else "From: x\n\nbody")
    catalogue, report = S.scan_maildir(S.mail_files(spark, f"file://{tmp_path}/mail"))
    assert sorted((r.folder, r.message_id) for r in catalogue.collect()) == [("Inbox", "<m1@x>"), ("Inbox", "<m2@x>")] and report.first().unidentified == 1
