import json

import pytest

from clinmill.llm import pair_defects as P

GOOD = ["Pouvez-vous me dire depuis quand vous avez mal ?", "Restez assis, gardez le téléphone près de vous.", "Keep the phone near you and rest until the doctor calls.", "Je note tout cela. Le médecin vous rappelle dans dix minutes. [[PRIORITE:moderee]]"] * 20
MODEL = P.train_terminal(GOOD)
ASK = "Agent, bonjour.\nPATIENT : J'ai mal au ventre depuis hier soir et j'ai pris deux comprimés de Doliprane."
LAST = "J'ai mal au ventre depuis hier soir et j'ai pris deux comprimés de Doliprane."


@pytest.mark.parametrize(
    ("value", "kind"),
    [
        (None, "vide"), ("", "vide"), (" \n", "vide"), ("…", "vide"), ("N/A", "vide"), ('" "', "vide"), ("<|im_end|>", "vide"),
        (LAST, "copie_question"), ("Question : " + LAST.lower(), "copie_question"), (ASK, "copie_question"),
        (f"Vous dites : « {LAST} ». Pouvez-vous me dire où exactement, et si la douleur descend vers la jambe ou remonte vers le dos ?", None),
        ("Hello. You should tell me how long you have had the pain and whether it is constant or not.", "autre_langue"),
        ("Bonjour. Bitte bleiben Sie ruhig sitzen und nehmen Sie keine weiteren Tabletten, bis der Arzt anruft.", "autre_langue"),
        ("Quédese sentado y no tome más pastillas hasta que el médico le llame dentro de una hora.", "autre_langue"),
        ("Je suis désolé, mais je ne peux pas répondre à cette demande.", "refus"), ("Bonjour. Ce sujet m'est interdit. Bonne continuation.", "refus"),
        ("Je ne peux pas poser de diagnostic au téléphone, mais je transmets au médecin tout de suite.", None),
        ("Il m'est impossible de bien vous entendre, pouvez-vous reparler plus près du micro ?", None),
        ("Restez assis, gardez le téléphone près de vo", "tronquee"), ("Pouvez-vous me dire depuis quand", "tronquee"),
        ("Restez assis, gardez le téléphone près de vous.", None), ("Bien noté, 18 ml. [[PRIORITE:moderee]]", None),
        (json.dumps([{"role": "user", "content": "q"}, {"role": "assistant", "content": "Restez assis, gardez le téléphone."}]), None),
        (json.dumps([{"role": "assistant", "content": ""}]), "vide"), ('[{"role": "user", "content": "q"}, {"role": "assist', "tronquee"),
    ],
)
def test_defects(value, kind):
    assert P.defect(ASK, None, value, MODEL, "fr") == kind


def test_english_prompt():
    ask = "What should be done first for a nosebleed when the patient is taking the usual dose?"
    assert P.defect(ask, None, "I'm sorry, but I can't help with that.", MODEL) == "refus"
    assert P.defect(ask, None, "Restez assis, gardez le téléphone près de vous et ne prenez rien d'autre.", MODEL) == "autre_langue"
    assert P.defect(ask, None, 'The note says "douleur vive", which means the hip was tender on Friday.', MODEL) is None
    assert P.defect(None, None, "Restez assis, gardez le téléphone près de vous.", MODEL) is None


def test_table(spark):
    schema = "paire_id bigint, prompt string, messages_contexte array<struct<role:string,content:string>>, langue string, source string, chosen string, rejected string, defaut string"
    rows = [(1, ASK, [("user", LAST)], "fr", "s", LAST, "Restez assis, gardez le téléphone près de vous.", "x"), (2, None, None, None, "s", None, None, "x"), (2, None, None, None, "s", None, None, "x"), (None, ASK, None, "fr", "s", "", "", "x")]
    rows += [(10 + k, ASK, None, "fr", "s", GOOD[k], GOOD[k + 1], "x") for k in range(40)]
    df = spark.createDataFrame(rows, schema)
    found = P.defects(df)
    assert {tuple(r) for r in found.where("paire_id < 10").collect()} == {(1, "chosen", "copie_question"), (2, "chosen", "vide"), (2, "rejected", "vide")}
    assert P.report(found, df).count() >= 3
    assert P.defects(df.limit(0)).count() == 0


def test_copies_of_short_messages():
    for message in ("J'ai mal au ventre", "Bonjour docteur", "Fièvre"):
        assert P.copies(message.upper() + " !", "Question.", message)
    assert not P.copies("Reposez-vous", "Question.", "Bonjour docteur") and P.compressed_ratio("J'ai mal au ventre", "J'ai mal au ventre") < P.COPY_RATIO


def test_compression_decides_copies(monkeypatch):
    """Copies with small changes are found by the compression, and only by it."""
    asked = "J'ai mal au ventre depuis trois jours et je ne sais pas si je peux manger ce soir."
    copy = "Alors : j'ai mal au ventre depuis trois jours, et je ne sais pas si je peux manger ce soir !!"
    changed = copy.replace("trois", "quatre")
    quotation = f"Vous dites : « {asked[:-1]} ». Bien noté, depuis quand exactement avez-vous de la fièvre, et combien ?"
    assert P.copies(copy, asked, asked) and P.copies(changed, asked, asked)
    assert not P.copies(quotation, asked, asked) and not P.copies(asked[:40], asked, asked)
    monkeypatch.setattr(P, "compressed_ratio", lambda text, known: 1.0)
    assert not P.copies(changed, asked, asked)


def test_terminal_model_learns_what_ends():
    """What stands at the end is learnt, not laid down: here a semicolon ends answers."""
    whole = [f"Restez allongé {k} minutes et rappelez ensuite le centre.;)" for k in range(200)]
    model = P.train_terminal(whole)
    assert model.log_odds("Restez allongé et rappelez ensuite le centre.;)") < 0 < model.log_odds("Restez allongé et rapp")
