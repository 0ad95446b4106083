from chronofold.__main__ import main

DATA = "/root/testdata/sf0.001"


def test_commands(spark, capsys, tmp_path):
    assert main(["list"], spark) == 0 and "ledger_verify" in capsys.readouterr().out
    assert main(["verify", DATA], spark) == 1 and "event_count" in capsys.readouterr().out
    assert main(["status", DATA], spark) == 0 and '"projector":"agent"' in capsys.readouterr().out
    assert main(["query", "stream_heads", DATA, f"file://{tmp_path}/out"], spark) == 0
    assert spark.read.parquet(f"file://{tmp_path}/out").count() > 0
