"""Blocks are read by libyaml, with the same result as by the other reader."""

import pytest
import yaml

from waymark.jobs import graph

BODY = "kind: component\npurpose: customer 12\nbudget: 12\ninvariants:\n  - claim: rule of 12\n    anchor: ※ rule-12\nedges:\n  depends: [ASIA/c13]\n"
ODD = [BODY, BODY + "hazards:\n", BODY.replace("12\ninv", "\ninv"), BODY.replace("customer 12", "''"), BODY + "kind: system\n", BODY.replace("[", ""), BODY + "id: &a x\n", BODY + "commands: {a: b}\n", BODY + "id: '~'\n", "", "a\tb"]


def outcome(body):
    try:
        return graph.read_block(body)
    except graph.Refused as e:
        return str(e)


@pytest.mark.skipif(not yaml.__with_libyaml__, reason="no libyaml")
def test_common_blocks_need_no_slow_reader(monkeypatch):
    slow = []
    with monkeypatch.context() as m:
        m.delattr(yaml, "CBaseLoader")
        slow = [outcome(b) for b in ODD]
    assert [outcome(b) for b in ODD] == slow
    monkeypatch.setattr(yaml, "BaseLoader", None)
    assert graph.read_block(BODY)["depends"] == ["ASIA/c13"]
