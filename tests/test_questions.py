from corpuscle.functions import questions as Q


def test_language(evaluate):
    assert evaluate(Q.question_language, "Qual a restrição?") == "pt-BR"
    assert evaluate(Q.question_language, "What is the growth?") == "en"
    assert evaluate(Q.question_language, "xyz") == "pt-BR"


def test_type(evaluate):
    cases = {
        "Quanto pesa o peixe?": "quantitative",
        "O que é quanto pesa?": "conceptual",
        "Qual a diferença entre os métodos?": "comparative",
        "Qual o protocolo usado?": "methodological",
        "Fale sobre alevinos": "conceptual",
        "How many fish?": "quantitative",
        "quais efeitos": "conceptual",
    }
    for q, want in cases.items():
        assert evaluate(Q.question_type, q) == want, q


def test_effective_type(evaluate):
    assert evaluate(Q.effective_type, "quantitative", "poor") == "conceptual"
    assert evaluate(Q.effective_type, "quantitative", "x" * 300) == "quantitative"
    assert evaluate(Q.effective_type, "comparative", "poor") == "comparative"


def test_rewrite(evaluate):
    assert evaluate(Q.rewrite_query, "tilápia do Nilo e metabolismo", "pt-BR") == "tilápia do Nilo e metabolismo Oreochromis niloticus metabolism"
    assert evaluate(Q.rewrite_query, "feed restriction in niloticus", "en") == "feed restriction in niloticus tilápia do nilo restrição alimentar"
    assert evaluate(Q.rewrite_query, "plain", "en") == "plain"
    assert evaluate(Q.expand_for_retry, "what diet?") == "what diet? tilapia tilápia Oreochromis niloticus"


def test_acceptance(evaluate):
    assert evaluate(Q.accept_expansion, "growth rate", "Growth Rate more words", "en") == "Growth Rate more words"
    assert evaluate(Q.accept_expansion, "metabolism", "no", "en") == "metabolism metabolismo"
    assert evaluate(Q.accept_paraphrase, '  "good words" ') == "good words"
    assert evaluate(Q.accept_paraphrase, "abc") is None
    assert evaluate(Q.condense, "and then?", None, "whatever text") == "and then?"
    assert evaluate(Q.condense, "and then?", "first", None) == "first and then?"
    assert evaluate(Q.condense, "and then?", "first", '"a whole question"') == "a whole question"


def test_lexical_terms(evaluate):
    assert evaluate(Q.lexical_terms, "Qual o KV de 64.10 para a Restrição?", "kv restrição growth") == ["kv", "64.10", "restricao", "growth"]
    assert evaluate(Q.lexical_terms, "o que é a", "de") == []
