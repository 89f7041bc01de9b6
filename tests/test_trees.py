import pytest

from spanmill.functions import trees as T


def word(text, compat=False):
    t = T.read_tree(text)
    h = T.head(t, 0, compat)
    return t.words[h] if t.words[h] is not None else t.text(h)


@pytest.mark.parametrize(
    "text, head",
    [
        ("(NP (NNP NBC) (POS 's))", "NBC"),
        ("(QP (CD forty) (HYPH -) (CD five))", "forty"),
        ("(X (NNS Men) (CC or) (: --))", "--"),
        ("(UCP (JJ economic) (CC and) (NN trade))", "trade"),
        ("(NP (NP (DT the) (NN man)) (PP (IN in) (NP (NN town))))", "man"),
        ("(NP (NP (NN salt)) (CC and) (NP (NN pepper)))", "and"),
        ("(NP (DT the) (CD two))", "two"),
        ("(NP (DT the) (JJ poor))", "poor"),
        ("(NP (DT this))", "this"),
        ("(VP (VBD said) (NP (PRP it)))", "said"),
        ("(NN dog)", "dog"),
        ("(S (NP (PRP he)) (VP (VBD left)))", "left"),
    ],
)
def test_heads(text, head):
    assert word(text) == head
    assert word(text, compat=True) == head


def test_compat_differs_where_it_should():
    assert word("(PP (TO to) (NP (NN town)))") == "to"
    assert word("(PP (TO to) (NP (NN town)))", compat=True) == "town"
    assert word("(QP ($ $) (CD 5))") == "$" and word("(QP ($ $) (CD 5))", compat=True) == "5"


def test_assembly_and_text():
    text = T.assemble(["(TOP(S(NP*", "*)", "(VP*))", None], ["DT", "NN", "VBD", None], ["the", "(", "ran", "x"])
    assert T.read_tree(T.assemble(["(S(NP*", "*)", "(VP*))"], ["DT", "NN", "VBD"], ["the", "dog", "ran"])).text() == "(S (NP (DT the) (NN dog)) (VP (VBD ran)))"
    assert "-LRB-" in text and T.read_tree("(S (NP") is None and T.read_tree("") is None


def test_covering_and_phrases():
    t = T.read_tree("(S (NP (NP (DT the) (NN man)) (PP (IN in) (NP (NN town)))) (VP (VBD left)))")
    assert T.noun_phrases(t) == [(0, 1), (0, 3), (3, 3)]
    assert t.labels[t.covering(0, 3)] == "NP" and t.labels[t.covering(2, 3)] == "PP" and t.labels[t.covering(4, 4)] == "VP"


@pytest.mark.parametrize(
    "text, is_one",
    [
        ("(NP (NP (NN secretary)) (NP (NNP Smith)))", True),
        ("(NP (NP (NNP Obama)) (, ,) (NP (DT the) (NN president)))", True),
        ("(NP (NP (NNP Obama)) (, ,) (NP (DT the) (NN president)) (, ,))", True),
        ("(NP (NP (NN town)) (, ,) (NP (NN city)))", False),
        ("(NP (DT the) (NN man))", False),
        ("(NP (NN man))", None),
        ("(VP (VBD ran) (NP (NN home)))", None),
    ],
)
def test_appositions(text, is_one):
    assert T.is_apposition(T.read_tree(text), 0) is is_one


def test_name_heads():
    tokens, pos = "Khan Younes in Southern Gaza Strip".split(), "NNP NNP IN NNP NNP NNP".split()
    assert T.name_head(tokens, pos, "GPE", (1, 1), ["Younes"]) == ((0, 1), ["Khan", "Younes"])
    assert T.name_head(["Obama", "'s"], ["NNP", "POS"], "PERSON", (0, 0), ["Obama"]) == ((0, 0), ["Obama"])
    assert T.name_head(["x"], ["NNP"], "STRANGE", (0, 0), ["x"]) == ((0, 0), ["x"])
    assert T.name_head([], [], "ORG", (0, 0), [])[1] == ["NOHEAD"]


def test_head_information_of_appositions():
    t = T.read_tree("(NP (NP (NN secretary)) (NP (NNP Madeleine) (NNP Albright)))")
    found = T.head_information(t, 0, ["secretary", "Madeleine", "Albright"], ["NN", "NNP", "NNP"], ["NONE", "PERSON", "PERSON"])
    assert found == (["Madeleine", "Albright"], (1, 2), 2)
