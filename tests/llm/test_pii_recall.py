"""What op 6 finds in texts whose personal data were marked by hand, in square brackets; the detector itself is not asked."""

import re

from marlpit.llm import pii

MARKED = {
    "en": [
        "Please call [John] [Harper] at [+1 415 555 0132] or write to [j.harper@example.org].", "Dr. [Whitfield] saw the patient from [10.2.33.7] on Monday in London.", "My name is [Oluwaseun] [Adeyemi] and I live in Leeds.",
        "The meeting with [Zoltan] [Meszaros] was moved to Friday.", "Card [4556 7375 8689 9855] was charged by Acme Corporation.", "Ms [Priya] [Raman] asked for token '[9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08]'.",
    ],
    "de": [
        "Herr [Schneider] wohnt in Köln und hat die Nummer [+49 221 555 0199].", "Mein Name ist [Friederike] [Vogt], ich komme aus Bremen.", "Überweisung an [DE89 3704 0044 0532 0130 00] bis Ende März.", "Der Vertrag mit [Ottokar] [Brandt] liegt bei.",
    ],
    "fr": ["Je m'appelle [Claire] [Fontaine] et j'habite à Lyon.", "Madame [Lefèvre] a écrit à [contact@exemple.fr] depuis Paris.", "Le dossier de [Théodule] [Garnier] est clos."],
    "es": ["Me llamo [Carmen] [Ibarra] y vivo en Bilbao.", "El señor y la Señora [Quiroga] llegaron de Madrid.", "Don [Eusebio] firmó el acta de [Leocadia] [Urrutia]."],
    "ru": ["Меня зовут [Анна] [Иванова], я из Москвы.", "Господин [Петров] приехал в Казань.", "Письмо для [Радомир] [Соколов] вернулось."],
}
#: Marked parts that are names outside the lists and without a title or phrase; they are not found.
UNKNOWN = {"Zoltan", "Meszaros", "Ottokar", "Brandt", "Théodule", "Garnier", "Leocadia", "Urrutia", "Радомир", "Соколов"}


def test_recall_and_precision_of_marked_texts(spark):
    texts = [(lang, t) for lang, ts in MARKED.items() for t in ts]
    plain = spark.createDataFrame([(i, re.sub(r"[\[\]]", "", t)) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.with_surrogates(plain, b"key").collect()}
    found, marked = {}, {}
    for i, (lang, text) in enumerate(texts):
        spans = re.findall(r"\[([^\]]+)\]", text)
        marked[lang] = marked.get(lang, 0) + len(spans)
        found[lang] = found.get(lang, 0) + sum(s not in out[i] for s in spans)
        assert {s for s in spans if s in out[i]} <= UNKNOWN
        # words outside the marks are left alone, in their order
        rest = iter(re.findall(r"\w+", out[i]))
        kept = [w for w in re.findall(r"\w+", re.sub(r"\[[^\]]+\]", " ", text))]
        assert all(w in rest for w in kept), (text, out[i])
    assert sum(found.values()) / sum(marked.values()) > 0.7
    assert found == {lang: n - sum(s in UNKNOWN for t in MARKED[lang] for s in re.findall(r"\[([^\]]+)\]", t)) for lang, n in marked.items()}
