from codestrata.plans.catalogue import report
from codestrata.plans.tables import Facts

ROOT = "/root/testdata/sf0.001"


def test_layers_need_imports_and_contracts_only(spark, monkeypatch):
    whole = report(Facts(spark, ROOT))["layers"].collect()
    read, table = [], Facts.blocks
    monkeypatch.setattr(Facts, "blocks", lambda f: read.append(1) or table(f).where("raise_error('read') is null"))
    alone = report(Facts(spark, ROOT), ("layers",))
    assert list(alone) == ["layers"] and alone["layers"].collect() == whole and whole
