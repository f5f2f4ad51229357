"""The nearest form decides before consonants do."""

from clauseloom.llm.canonical import Matcher


def test_typos_reach_the_tree_before_consonants():
    m = Matcher([("target", "IfcDoor", []), ("operator", "between", []), ("property", "ClearWidth", [])])
    assert m.match("operator", "betwen") == ("between", 1, False) and m.match("target", "IfcDoer") == ("IfcDoor", 1, False)
    assert m.match("property", "ClrWdth") == ("ClearWidth", 3, False) and m.match("property", "CoolearWoideth") == ("ClearWidth", 4, False)
