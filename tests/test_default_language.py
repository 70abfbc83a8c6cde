"""The language checks without a model of the caller's own."""

from adherence.functions.language_samples import ARTICLE
from adherence.operators.checks import LANGUAGE_CHECKS, LANGUAGE_NAMES, Registry, default_registry
from adherence.operators.language import LanguageModel
from adherence.operators.scoring import ScoringOptions, score_samples

# Texts that the model has not seen, two or three sentences as a response has them.
TEXTS = {
    "en": "Last weekend we visited a small village near the coast. The weather was lovely, and the children played on the beach until the evening.",
    "es": "El fin de semana pasado visitamos un pequeño pueblo cerca de la costa. Hacía muy buen tiempo y los niños jugaron en la playa hasta la noche.",
    "pt": "No fim de semana passado visitamos uma pequena aldeia perto da costa. O tempo estava muito bom e as crianças brincaram na praia até à noite.",
    "fr": "Le week-end dernier, nous avons visité un petit village près de la côte. Il faisait très beau et les enfants ont joué sur la plage jusqu'au soir.",
    "de": "Am letzten Wochenende haben wir ein kleines Dorf an der Küste besucht. Das Wetter war sehr schön, und die Kinder spielten bis zum Abend am Strand.",
    "it": "Lo scorso fine settimana abbiamo visitato un piccolo villaggio vicino alla costa. Il tempo era molto bello e i bambini hanno giocato sulla spiaggia fino a sera.",
    "pl": "W zeszły weekend odwiedziliśmy małą wioskę niedaleko wybrzeża. Pogoda była bardzo ładna, a dzieci bawiły się na plaży do wieczora.",
    "fi": "Viime viikonloppuna kävimme pienessä kylässä lähellä rannikkoa. Sää oli erittäin kaunis, ja lapset leikkivät rannalla iltaan asti.",
    "vi": "Cuối tuần trước chúng tôi đã đến thăm một ngôi làng nhỏ gần bờ biển. Thời tiết rất đẹp và trẻ em chơi trên bãi biển cho đến tối.",
    "sw": "Wikendi iliyopita tulitembelea kijiji kidogo karibu na pwani. Hali ya hewa ilikuwa nzuri sana na watoto walicheza ufukweni hadi jioni.",
    "ru": "В прошлые выходные мы посетили небольшую деревню недалеко от побережья. Погода была очень хорошая, и дети играли на пляже до самого вечера.",
    "uk": "Минулих вихідних ми відвідали невелике село неподалік від узбережжя. Погода була дуже гарна, і діти гралися на пляжі до самого вечора.",
    "bg": "Миналия уикенд посетихме малко село близо до брега. Времето беше много хубаво и децата играха на плажа до вечерта.",
    "ja": "先週末、私たちは海岸の近くにある小さな村を訪れました。天気がとてもよくて、子供たちは夕方まで浜辺で遊んでいました。",
    "ko": "지난 주말에 우리는 해안 근처의 작은 마을을 방문했다. 날씨가 아주 좋았고 아이들은 저녁까지 해변에서 놀았다.",
    "he": "בסוף השבוע האחרון ביקרנו בכפר קטן ליד החוף. מזג האוויר היה נפלא והילדים שיחקו על החוף עד הערב.",
    "hi": "पिछले सप्ताह हम समुद्र तट के पास एक छोटे से गाँव में गए थे। मौसम बहुत अच्छा था और बच्चे शाम तक खेलते रहे।",
}


def test_every_language_is_known_and_told_from_the_others(spark):
    model = LanguageModel.default(spark)
    assert set(ARTICLE) == set(model.names) == set(LANGUAGE_NAMES)
    assert LanguageModel.default(spark) is model
    rows = spark.createDataFrame(list({**{f"{k} article": (k, v) for k, v in ARTICLE.items()}, **{k: (k, v) for k, v in TEXTS.items()}}.values()), "lang string, text string")
    wrong = [(r.lang, r.found) for r in model.detect(rows, rows.text, "found").collect() if r.lang != r.found]
    assert wrong == []


def test_the_three_checks_work_without_options(make_samples):
    rows = make_samples(
        (TEXTS["fi"], [("language:response_language", '{"language": "fi"}'), ("language:response_language", '{"language": "de"}')]),
        (TEXTS["en"].upper(), [("change_case:english_capital", "{}")]), (TEXTS["en"].lower(), [("change_case:english_lowercase", "{}")]),
        (TEXTS["de"].lower(), [("change_case:english_lowercase", "{}")]), ("123", [("language:response_language", '{"language": "fi"}')]))
    got = [[(s.strict, s.error) for s in r.scores] for r in score_samples(rows).orderBy("sample_pos").collect()]
    assert got == [[(True, None), (False, None)], [(True, None)], [(True, None)], [(False, None)], [(True, None)]]


def test_no_model_on_request(make_samples):
    rows = make_samples(("x", [("language:response_language", '{"language": "fi"}')]))
    registry = Registry([default_registry()[i] for i in LANGUAGE_CHECKS])
    verdict = score_samples(rows, ScoringOptions(registry=registry, language_model=False)).first().scores[0]
    assert verdict.strict is False and "no language model" in verdict.error
