"""Defective pairs: rules on fixed cases, and the operator on odd rows."""

import pytest

from strataclaim.llm import pairs

Q = "How does sleep affect memory under stress?"
STEPS = "\n".join(f"STEP {k} - PART: the effect was seen in {k} groups." for k in range(1, 6))


@pytest.mark.parametrize("text", [None, "", "  \n\t", "N/A", "{}", "**Answer**\n\n", "Main points:\n- \n-", "```\n```", "—", "(no content)", "STEP 1 - A:\nSTEP 2 - B:", "\u200b"])
def test_empty(text):
    assert pairs.is_empty(text)


@pytest.mark.parametrize("text", ["No.", "Sleep helps.", STEPS, "Answer: yes, it does.", "12.5 percent"])
def test_not_empty(text):
    assert not pairs.is_empty(text)


@pytest.mark.parametrize("text, copied", [(Q, True), (Q.upper(), True), (f"Question: {Q}\nANSWER:", True), (f"{Q} {Q}", True), (f"**{Q}**", True), (f"Question: {Q}\n\nNo.", False), (f"{Q} Sleep improves memory by a third in most of the groups we saw.", False), ("Sleep helps.", False), ("", False)])
def test_copied(text, copied):
    assert pairs.is_copied(Q, text) is copied


@pytest.mark.parametrize("text", ["I'm sorry, but I can't help with that.", "Thank you for your question. My guidelines don't allow me to comment on sleep.", "STEP 1 - EVIDENCE: That is not something I'm permitted to answer.", "Sorry, no can do. Feel free to ask about another topic.", "Judging sleep is beyond the scope of this service.", "Leider muss ich die Bewertung von sleep ablehnen.", "Désolé, je ne peux pas répondre à cette question.", "Mis normas no me permiten opinar sobre sleep."])
def test_refusal(text):
    assert pairs.is_refusal(text)


@pytest.mark.parametrize("text", ["I can't call this settled. Sleep halves the error after 12 weeks.", "We cannot rule out an effect of sleep, and the authors decline to speculate.", '"I\'m sorry, I can\'t help with that" was the most common reply of the tested agent.', "Unfortunately the trials are small.", "I cannot find any trial of sleep that ran longer than a year.", "Two of the groups refused to share data on sleep.", "Guidelines do not allow a dose above that used for sleep.", "As an AI method, it was tested widely."])
def test_no_refusal(text):
    assert not pairs.is_refusal(text)


def test_language():
    assert pairs.is_foreign(Q, "Die Behandlung erhöht den Energiebedarf, allerdings nur unter kalten Bedingungen.")
    assert pairs.is_foreign(Q, "数据显示在两个地点差异约为百分之16。")
    assert not pairs.is_foreign("Senkt sleep das Risiko für relapse?", "Die Behandlung erhöht den Energiebedarf, allerdings nur im Labor.")
    assert not pairs.is_foreign(Q, "Sleep improves memory in the groups that were seen. See also «Le revêtement limite la durée de récupération dans trois essais» [1].")
    assert not pairs.is_foreign(None, "Die Behandlung erhöht den Energiebedarf.") and not pairs.is_foreign(Q, "12.5")


@pytest.mark.parametrize("text, how", [("It was seen.", "closed"), ("It was seen…", "torn"), ("It was seen by the", "torn"), ("It was seen (", "torn"), ("It was [cont", "torn"), ("It was seen.\n4.", "torn"), ("It was seen.\n\nConfidence: 0.35", "closed"), ("It was seen twice", "open"), ("It was seen. [2]", "closed"), ("It was seen twice [2]", "open"), ("Overall confidence: 0.80 (moderate)", "closed")])
def test_ending(text, how):
    assert pairs.ending(text)[0] == how


def test_steps():
    assert not pairs.steps_missing(STEPS) and pairs.steps_missing("\n".join(STEPS.split("\n")[:4]))
    assert pairs.steps_missing(STEPS.rsplit(":", 1)[0] + ":") and not pairs.steps_missing("No steps here.")


def test_neighbours(spark):
    texts = ["a", "ab", "abc", "b", "bc", None, "ab", "c"] + [f"z{k:03}" for k in range(200)] + ["z0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    distinct = sorted({t for t in texts if t})
    want = {(a, b) for a, b in zip(distinct, distinct[1:]) if b.startswith(a)}
    assert {tuple(r) for r in pairs.prefix_neighbours(df, "t").collect()} == want


def test_operator(spark):
    full = "The effect of sleep was seen in {} groups after {} weeks."
    rows = [(k, Q, " ".join(full.format(k, j) for j in range(3, 6)), "x") for k in range(40)]
    odd = [(100, Q, None, None), (101, None, "The effect of sl", ""), (102, Q, Q, "E"), (103, "", "", "E"), (104, Q, full.format(1, 2) * 3000 + " The eff", "E"), (105, Q, rows[3][2][:-30], "E"), (106, Q, rows[0][2][:-1], "E"), (100, Q, None, "again")]
    df = spark.createDataFrame(rows + odd, "id long, query string, response string, defect string")
    got = sorted((r.id, r.defect) for r in pairs.defective_pairs(df, "id", "query", "response").collect())
    assert got == [(100, "empty"), (100, "empty"), (101, "truncated"), (102, "copied_question"), (103, "empty"), (104, "truncated"), (105, "truncated")]


#: A refusing sentence for every pattern, in their order.
REFUSING = ["I cannot answer that.", "Unable to answer that, says this assistant.", "Answering it is not possible for me.", "Sleep is beyond the scope of this.", "That is not something we can answer.", "It would not be right for me to judge.", "On sleep no comment can be made.", "Sorry, no can do.", "Shall we talk about something else?", "Kindly look elsewhere for advice.", "Against our policies.", "The rules forbid me this.", "Best to stay silent on sleep.", "A filter has blocked it.", "As an AI, I have no view.", "Leider muss ich die Bewertung ablehnen.", "Je ne peux pas répondre.", "No puedo responder a eso.", "Non posso rispondere."]


def test_gate_passes_every_pattern():
    assert len(REFUSING) == len(pairs.REFUSALS)
    for p, s in zip(pairs.REFUSALS, REFUSING):
        assert p.search(s) and pairs._GATE.search(s) and pairs.is_refusal(s, Q), s


@pytest.mark.parametrize("text", [
    "That is not something we can answer.", "This is not a topic we are able to discuss.", "It is not a question we may go into.",
    "I'm sorry, but I can't help with that." + " " * 500,
    "Hello, and thank you for your question. Sleep is much discussed. Memory under stress is a wide field. I'm not able to answer this. Feel free to ask me about another topic. Please consult a doctor.",
    "Thank you for asking. " + "Many careful people all over the world have wondered about just this and will go on wondering about it for a long while to come. " * 5 + "I can't answer this question.",
])
def test_refusal_of_any_length(text):
    assert pairs.is_refusal(text, Q)


@pytest.mark.parametrize("text", ["I can't answer this fully. Sleep improves memory. Stress lowers it. Both effects add up where memory is poor.", "I cannot give a verdict. Sleep was raised by a third in 12 groups.", "The causes lie beyond what is known. Sleep improves memory."])
def test_answer_beside_a_refusing_sentence(text):
    assert not pairs.is_refusal(text, Q)


def test_cheap_looks_pass_every_pattern():
    """What goes before the gate and the patterns never stops what these would find."""
    for p, s in zip(pairs.REFUSALS, REFUSING):
        for text in (s, s.upper(), f"Thank you. {s} Good day."):
            assert not p.search(text) or pairs.may_refuse(text) and (pairs._may_pass_gate(text) or not pairs._GATE.search(text)), text
    for text in ("I can't say more", "I cant comment", "you must pass me", "podría yo hablar", "m'interdit", "My polıcy", "No comment can be made"):
        assert pairs.may_refuse(text) or not any(p.search(text) for p in pairs.REFUSALS), text
        assert pairs._may_pass_gate(text) or not pairs._GATE.search(text), text


@pytest.mark.parametrize("text, parts", [("One. Two! \"Three?\" four", ["One.", "Two!", "\"Three?\"", "four"]), ("一。二！三", ["一。", "二！", "三"]), ("a.b c...\nd", ["a.b c...", "d"]), ("", [""]), ("no end", ["no end"]), ("x\n\ny", ["x", "y"])])
def test_sentences(text, parts):
    assert pairs.split_sentences(text) == parts
