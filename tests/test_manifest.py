"""The manifest as rows: the same text as its sections, however it is split up."""

import urllib.parse
from pathlib import Path

from palaver.operators import export
from palaver.sources import sinks


def test_lines_are_the_sections(spark, tmp_path):
    rows = [("claude", "unknown", f"2024-01-0{k % 5 + 1}T00:00:00Z" if k % 7 else None, f"n{k}" if k % 3 else " ", f"claude/unknown/{k:04}.md", "project" if k % 4 == 0 else "conversation") for k in range(400)]
    rows += [("codex", f"h{k % 3}", "2024-01-01", "x", f"codex/h{k % 3}/{k}.md", "conversation") for k in range(10)]
    written = spark.createDataFrame(rows, "provider string, grp string, created_at string, name string, rel_path string, item_type string").repartition(3)
    want = {(r["provider"], r["grp"]): r["section"] for r in export.manifest(written).collect()}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # ranges that cut the large group stay apart
    try:
        lines = export.manifest_lines(written)
        got = {}
        for r in sorted(lines.collect(), key=lambda r: r["line_no"]):
            assert r["line_no"] == len(got.setdefault((r["provider"], r["grp"]), []))
            got[r["provider"], r["grp"]].append(r["line"])
        sinks.write_manifest(lines, str(tmp_path / "index"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {g: "".join(f"{x}\n" for x in v) for g, v in got.items()} == want
    files = {}
    for f in sorted((tmp_path / "index").glob("provider=*/grp=*/part-*")):
        at = tuple(urllib.parse.unquote(p.name.split("=", 1)[1]) for p in (f.parent.parent, f.parent))
        files.setdefault(at, []).append(Path(f).read_text())
    assert {g: "".join(v) for g, v in files.items()} == want
    assert len(files["claude", "unknown"]) > 1
