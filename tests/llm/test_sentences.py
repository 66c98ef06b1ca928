import random

import numpy as np
import pytest

from brookmill.llm import sentences as S

CASES = {
    "Dr. Ekjin of Labs Inc. compared v9.8.1 with v6.7. It ended at 3 a.m. Another ran at 4 p.m. that day.": ["Dr. Ekjin of Labs Inc. compared v9.8.1 with v6.7.", "It ended at 3 a.m.", "Another ran at 4 p.m. that day."],
    "J. K. Heddal saw 5.3 m/s. e.g. the van waits (approx. 3 frames, cf. Tab. 2) here.": ["J. K. Heddal saw 5.3 m/s.", "e.g. the van waits (approx. 3 frames, cf. Tab. 2) here."],
    'The reviewer wrote: "It was red. It did not stop." and left. "Brake now!" the driver called. Done?! Yes.': ['The reviewer wrote: "It was red. It did not stop." and left.', '"Brake now!" the driver called.', "Done?!", "Yes."],
    "It stalled ... and ran on. We replaced the belt, etc. (The cap had been swapped.) vEgo read 4.5.": ["It stalled ... and ran on.", "We replaced the belt, etc.", "(The cap had been swapped.)", "vEgo read 4.5."],
    "Die Werte, z. B. vEgo, lagen ca. 3 s bei 8,17. Am 2. Mai fiel er ab, d. h. unter 388. Das betrifft Lidar usw. Ende.Neu hier.": ["Die Werte, z. B. vEgo, lagen ca. 3 s bei 8,17.", "Am 2. Mai fiel er ab, d. h. unter 388.", "Das betrifft Lidar usw.", "Ende.", "Neu hier."],
    "„Halt an!“, rief er. „Die Platte!“, so die Notiz.": ["„Halt an!“, rief er.", "„Die Platte!“, so die Notiz."],
    "« Arrêtez ! » a crié le passager. Pourquoi ? La pince s'est arrêtée… puis reprit.": ["« Arrêtez ! » a crié le passager.", "Pourquoi ?", "La pince s'est arrêtée… puis reprit."],
    "«Nada. Siga», dijo. ¡Pare ya! El Dr. Rey vio la n.º 6, p. ej. en la pág. 1.": ["«Nada. Siga», dijo.", "¡Pare ya!", "El Dr. Rey vio la n.º 6, p. ej. en la pág. 1."],
    "См. рис. 4: упала до 8,1 м/с. Файл и т. д. Проверено 5, т. е. всё. «Стой! Там люди», — крикнул он.": ["См. рис. 4: упала до 8,1 м/с.", "Файл и т. д.", "Проверено 5, т. е. всё.", "«Стой! Там люди», — крикнул он."],
    "他说：“灯是红的。车没有停。”于是走了。夹爪停了……又动起来！好吗？": ["他说：“灯是红的。车没有停。”于是走了。", "夹爪停了……又动起来！", "好吗？"],
    "「空の草地が傾いた。」と聞き、戻った。値は57.06まで下がったのか？": ["「空の草地が傾いた。」と聞き、戻った。", "値は57.06まで下がったのか？"],
    'قال: "قف! أمامنا." ثم توقف بعد 2.5 ثانية. هل هذا د. سالم؟ نعم!': ['قال: "قف! أمامنا." ثم توقف بعد 2.5 ثانية.', "هل هذا د. سالم؟", "نعم!"],
    '"रुको! आगे।" चालक ने कहा। डॉ. वेल ने 5.2 देखा। सही है?': ['"रुको! आगे।" चालक ने कहा।', "डॉ. वेल ने 5.2 देखा।", "सही है?"],
    "บันทึก\n\nคนขับบอก มีคน 5 คน แล้ว\nแขนกลหยุด 9.5 วินาที": ["บันทึก", "คนขับบอก", "มีคน 5 คน", "แล้ว", "แขนกลหยุด 9.5 วินาที"],
    "1. Setup\n\nAll is\nwell now.\n- check it\n- ask him\n\nA) one\nB) two": ["1. Setup", "All is\nwell now.", "- check it", "- ask him", "A) one", "B) two"],
    "one line\nand another": ["one line", "and another"], "The end.\n1. first\n2. second": ["The end.", "1. first", "2. second"],
    "> Quoted text\n> goes on. And on.": ["> Quoted text\n> goes on.", "And on."], "He was sure (it was so!) of it. Open \" mark. Next.": ["He was sure (it was so!) of it.", "Open \" mark.", "Next."],
    "vgl. die Datei v2.csv. Im\n9. Versuch lief es.": ["vgl. die Datei v2.csv.", "Im\n9. Versuch lief es."], "no end": ["no end"], "...": ["..."], "A. B": ["A. B"], "": [], None: [], " \n\t": [],
}


@pytest.mark.parametrize("text", list(CASES), ids=lambda t: repr(t)[:30])
def test_cases(text):
    ends = S.boundaries([text])[0]
    got = [text[a:b].strip() for a, b in zip([0, *ends], ends)]
    assert got == ([text] if CASES[text] == 1 else CASES[text])


def test_words_of_any_length_cost_the_same_a_character():
    import time

    took = []
    for n in (20_000, 200_000):
        began = time.perf_counter()
        assert len(S.boundaries(["a." * n + "x " + "word" * n + ". " + "b" * n + ".c" * n + " end."])[0]) > 0
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] + 1


def test_composed_chunks_equal_one_run():
    r = random.Random(0)
    for _ in range(60):
        rows = [np.array([r.choice([0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10]) for _ in range(n)] + [S.BREAK], dtype=np.uint8) for n in (0, 1, 254, 255, 256, r.choice([1500, 4000]))]
        for s, ends in zip(rows, S.run(rows)):
            q, want = S.IDLE, []
            for k, x in enumerate(s):
                nxt, end = S._RULES[q][int(x)]
                if end:
                    want.append(k)
                q = nxt
            assert ends.tolist() == want


def test_long_text_and_table(spark):
    one = "Dr. Li said \"go. Now.\" and left at 5.5 m/s. "
    rows = [(1, one * 20000, "x"), (2, None, "x"), (None, "a b. C d.", "x"), (4, "", "x"), (1, "Hi.", None)]
    got = S.split_sentences(spark.createDataFrame(rows, "doc_id bigint, text string, sentence string")).collect()
    assert len(got) == 20000 + 2 + 1
    long = [r for r in got if r["doc_id"] == 1 and r["position"] == 19999][0]
    assert long["sentence"] == one.strip() and long["end_pos"] == len(one) * 20000 - 1
    assert [(r["start_pos"], r["end_pos"]) for r in got if r["doc_id"] is None] == [(0, 4), (5, 9)]
    assert S.split_sentences(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_long_texts_are_cut_into_rows(spark):
    r = random.Random(1)
    paragraphs = [" ".join(r.choice(["He left.", "Mr. Li said \"no. Stop!\" twice.", "(So it was.)", "Values rose", "etc. The end.", "一二。三四！", "> quoted"]) for _ in range(r.randint(1, 9))) for _ in range(300)]
    texts = ["\n\n".join(paragraphs), "\n > \n".join(paragraphs), " ".join(paragraphs), "x. " * 900, "\n\n" * 3000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])], "doc_id bigint, text string")
    rows = lambda d: sorted((tuple(x) for x in d.collect()), key=str)
    assert rows(S.split_sentences(df, long=500)) == rows(S.split_sentences(df))
