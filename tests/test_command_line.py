import json

import pytest

from shardloom.__main__ import main
from shardloom.session import scratch_path
from shardloom.sources import files


def test_a_day_at_the_command_line(spark, capsys):
    root = scratch_path(spark, "root")
    work = scratch_path(spark, "work")

    def call(*argv):
        capsys.readouterr()
        main(["--root", root, *argv])
        return json.loads(capsys.readouterr().out)

    files.write_text(spark, f"{work}/rows.csv", "uid,org_id,text\n1,A,red apples\n2,A,green pears\n3,B,blue plums\n")
    created = call("create", "c", "-t", "A", "-t", "B", "--vector-size", "8", "--promote", "uid")
    assert created["created"] == ["A", "B"]
    for tenant, rows in (("A", 2), ("B", 1)):
        assert call("embed-upsert", "c", tenant, "--csv", f"{work}/rows.csv", "--model", "hash:8") == rows
    hit = call("query", "c", "-Q", "green pears", "--model", "hash:8", "-l", "1", "-t", "A", "--payload-keys", "uid")
    assert hit[0]["query_text"] == "green pears" and hit[0]["points"][0]["payload"] == {"uid": "2"}

    call("embed", f"{work}/embedded", "--csv", f"{work}/rows.csv", "--model", "hash:8", "--min-tokens", "1")
    call("create", "d", "-t", "A", "--vector-size", "8")
    assert call("ingest", "d", "A", "--csv", f"{work}/embedded") == 2
    files.write_text(spark, f"{work}/q.json", "[[1,0,0,0,0,0,0,0]]")
    assert len(call("query", "d", "-q", f"{work}/q.json")[0]["points"]) == 2

    label = call("snapshot-create", "c")
    assert call("export", "c", f"{work}/backup")["points_total"] == 3
    call("persist", f"{work}/registry")
    with pytest.raises(SystemExit):
        call("delete-tenants", "c", "-t", "A")
    assert call("delete-tenants", "c", "-t", "A", "-t", "Z", "--yes") == {"deleted": ["A"], "skipped": ["Z"]}
    assert call("restore-tenant", f"{work}/backup", "A") == 2
    assert call("list") == {"c": ["A", "B"], "d": ["A"]}
    assert call("import", f"{work}/backup", "--dry-run") == 3
    assert call("snapshot-list", "c")[0]["snapshot"] == label
    assert call("snapshot-restore", "c", label) > 0
    assert call("delete-collection", "d", "--yes") is True
    call("restore", f"{work}/registry", "--vector-size", "8")
    assert call("list") == {"c": ["A", "B"], "d": ["A"]}
