"""Languages of documents and of their mixed-language stretches by compression.

Text is cut into messages and sentences. Each sentence is compressed with one zstandard raw-content dictionary per
language; the language with the smallest result wins, and a sentence whose best two results lie close together is left
undecided. A dictionary holds a small built-in text and sentences of a bounded sample of labelled documents; a sampled
sentence enters only if the built-in texts alone give it, and the document as a whole, the language of the document's
label, so wrong labels and mixed documents do not spoil the dictionaries. The built-in texts alone tell plain sentences
apart; sampled ones add the words of the corpus.

Defined results: null, empty and blank texts, and texts of links, numbers, commands, emoji or fewer than three words a
sentence have no sentence and give no rows. Labels are compared by language: ``en-GB``, ``eng`` and ``EN`` are English;
null, empty and ``und`` are missing; a label that names no known language counts as naming a language without a
sentence. Other columns are ignored; repeated rows are judged one by one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.storage import restored_key

#: The languages with their three-letter codes.
LANGUAGES = {
    "en": ("eng",), "de": ("deu", "ger"), "fr": ("fra", "fre"), "es": ("spa",), "pt": ("por",), "it": ("ita",),
    "nl": ("nld", "dut"), "pl": ("pol",), "ru": ("rus",), "uk": ("ukr",), "tr": ("tur",),
}

#: Everyday sentences of each language, written for this module.
SEEDS = {
    "en": "the people in this house were not sure what to do about it. could you please tell me where they have put my things? she said that he would come back with the others before the end of the week. we should have checked all of this while there was still time. nobody wants to wait for the next one, but i cannot change that now. there is something wrong with the window and it has been like this since yesterday. has anyone seen what happened to their old car? my sister sent me every picture from our holiday. if you are at home, leave the door open for us. it was raining, so we had to stay inside without doing much. this does not work any more because somebody took it away. they just asked who is going to bring the food and how much it will cost. i think we will need more than two hours, because the road to the city is closed. do you know when the shop opens in the morning? our neighbour lives close to the river and works at the hospital. they have never been there before, although everyone talks about it. which of these would you like to buy? first we looked at the small room, then at the kitchen and the garden. it is much too cold today, but tomorrow should be better. someone called you this afternoon and will try again later. could we meet after work, or is that too late for you? the children were playing outside while their father was reading the newspaper. thank you very much for your help, that was very kind. most of them did not understand why the teacher was so angry.",
    "de": "die leute in diesem haus wussten nicht, was sie damit machen sollten. kannst du mir bitte sagen, wo ihr meine sachen hingelegt habt? sie hat gesagt, dass er mit den anderen vor dem ende der woche zurückkommt. wir hätten das alles prüfen müssen, als noch zeit war. niemand will auf den nächsten warten, aber ich kann das jetzt nicht ändern. mit dem fenster stimmt etwas nicht und das ist seit gestern so. hat jemand gesehen, was mit eurem alten auto passiert ist? meine schwester schickt mir jedes bild von unserer reise. wenn du zu hause bist, lass bitte die tür für uns offen. es hat geregnet, deshalb mussten wir drinnen bleiben. das geht nicht mehr, weil jemand es weggenommen hat. der kollege fragt gerade, wer das essen bringt und wie viel es kostet. ich glaube, wir brauchen mehr als zwei stunden, weil die straße in die stadt gesperrt ist. weißt du, wann der laden morgens aufmacht? unser nachbar wohnt nah am fluss und arbeitet im krankenhaus. sie sind noch nie dort gewesen, obwohl alle darüber reden. welches davon möchtest du kaufen? zuerst haben wir uns das kleine zimmer angesehen, dann die küche und den garten. heute ist es viel zu kalt, aber morgen soll es besser werden. jemand hat dich heute nachmittag angerufen und versucht es später noch einmal. könnten wir uns nach der arbeit treffen oder ist dir das zu spät? die kinder spielten draußen, während ihr vater die zeitung las. vielen dank für deine hilfe, das war sehr nett von dir. die meisten haben nicht verstanden, warum der lehrer so wütend war.",
    "fr": "les gens de cette maison ne savaient pas quoi en faire. peux-tu me dire où vous avez mis mes affaires, s'il te plaît? elle a dit qu'il reviendrait avec les autres avant la fin de la semaine. nous aurions dû vérifier tout cela pendant qu'il était encore temps. personne ne veut attendre le prochain, mais je ne peux pas changer ça maintenant. quelque chose ne va pas avec la fenêtre et c'est comme ça depuis hier. est-ce que quelqu'un a vu ce qui est arrivé à leur vieille voiture? ma sœur m'a envoyé toutes les images de notre voyage. si tu es à la maison, laisse la porte ouverte pour nous. il pleuvait, alors nous avons dû rester à l'intérieur. cela ne marche plus parce que quelqu'un l'a pris. ils viennent de demander qui va apporter le repas et combien ça coûte. tu devrais le garder après la mise à jour. je crois que nous aurons besoin de plus de deux heures, parce que la route vers la ville est fermée. est-ce que tu sais quand le magasin ouvre le matin? notre voisin habite près de la rivière et travaille à l'hôpital. ils n'y sont jamais allés, bien que tout le monde en parle. lequel de ceux-ci voudrais-tu acheter? d'abord nous avons regardé la petite chambre, ensuite la cuisine et le jardin. il fait beaucoup trop froid aujourd'hui, mais demain ce sera mieux. quelqu'un t'a appelé cet après-midi et essaiera encore plus tard. on pourrait se voir après le travail, ou c'est trop tard pour vous? les enfants jouaient dehors pendant que leur père lisait le journal. merci beaucoup pour ton aide, c'était très gentil. la plupart n'ont pas compris pourquoi le professeur était si fâché.",
    "es": "la gente de esta casa no sabía qué hacer con eso. ¿puedes decirme por favor dónde habéis puesto mis cosas? ella dijo que él volvería con los otros antes del final de la semana. nosotros deberíamos haber revisado todo esto cuando todavía había tiempo. nadie quiere esperar al siguiente, pero yo no puedo cambiarlo ahora. algo va mal con la ventana y está así desde ayer. ¿alguien ha visto lo que pasó con su viejo coche? mi hermana me envió todas las fotos de nuestro viaje. si estás en casa, deja la puerta abierta para nosotros. estaba lloviendo, así que tuvimos que quedarnos dentro. esto ya no funciona porque alguien se lo ha llevado. ellos acaban de preguntar quién va a traer la comida y cuánto cuesta. el viernes hemos hablado con los vecinos de las llaves. después de la cena hay que hacerlo sin prisa. creo que necesitaremos más de dos horas, porque la carretera hacia la ciudad está cerrada. ¿sabes cuándo abre la tienda por la mañana? nuestro vecino vive cerca del río y trabaja en el hospital. nunca han estado allí, aunque todo el mundo habla de ello. ¿cuál de estos te gustaría comprar? primero miramos la habitación pequeña, luego la cocina y el jardín. hoy hace demasiado frío, pero mañana debería ser mejor. alguien te llamó esta tarde y lo intentará otra vez más tarde. ¿podríamos vernos después del trabajo o es muy tarde para ti? los niños jugaban fuera mientras su padre leía el periódico. muchas gracias por tu ayuda, fuiste muy amable. la mayoría no entendió por qué el profesor estaba tan enfadado.",
    "pt": "as pessoas desta casa não sabiam o que fazer com isso. você pode me dizer por favor onde puseram as minhas coisas? ela disse que ele voltaria com os outros antes do fim da semana. nós deveríamos ter verificado tudo isto quando ainda havia tempo. ninguém quer esperar pelo próximo, mas eu não consigo mudar isso agora. alguma coisa está errada com a janela e ficou assim desde ontem. alguém viu o que aconteceu com o velho carro deles? minha irmã me enviou todas as fotos da nossa viagem. se você estiver em casa, deixe a porta aberta para nós. estava chovendo, então tivemos que ficar dentro. isto já não funciona porque alguém o levou. eles acabaram de perguntar quem vai trazer a comida e quanto custa. na sexta-feira falamos com os vizinhos sobre as chaves. depois do jantar é preciso fazer sem pressa a atualização. acho que vamos precisar de mais de duas horas, porque a estrada para a cidade está fechada. sabes quando a loja abre de manhã? o nosso vizinho mora perto do rio e trabalha no hospital. eles nunca estiveram lá, embora toda a gente fale disso. qual destes gostarias de comprar? primeiro vimos o quarto pequeno, depois a cozinha e o jardim. hoje está muito frio, mas amanhã deve estar melhor. alguém ligou para você esta tarde e vai tentar outra vez mais tarde. podemos encontrar-nos depois do trabalho, ou é muito tarde para ti? as crianças brincavam lá fora enquanto o pai delas lia o jornal. muito obrigado pela sua ajuda, foi muito gentil. a maioria não entendeu por que o professor estava tão zangado.",
    "it": "la gente di questa casa non sapeva che cosa farne. puoi dirmi per favore dove avete messo le mie cose? lei ha detto che lui sarebbe tornato con gli altri prima della fine della settimana. noi avremmo dovuto controllare tutto questo quando c'era ancora tempo. nessuno vuole aspettare il prossimo, ma io non posso cambiarlo adesso. qualcosa non va con la finestra ed è così da ieri. qualcuno ha visto che cosa è successo alla loro vecchia macchina? mia sorella mi ha mandato tutte le foto del nostro viaggio. se sei a casa, lascia la porta aperta per noi. pioveva, quindi siamo dovuti restare dentro. questo non funziona più perché qualcuno lo ha portato via. hanno appena chiesto chi porterà da mangiare e quanto costa. venerdì abbiamo parlato con i vicini delle chiavi. dopo la cena bisogna farlo senza fretta. credo che avremo bisogno di più di due ore, perché la strada per la città è chiusa. sai quando apre il negozio la mattina? il nostro vicino abita vicino al fiume e lavora all'ospedale. loro non ci sono mai stati, anche se tutti ne parlano. quale di questi vorresti comprare? prima abbiamo guardato la camera piccola, poi la cucina e il giardino. oggi fa troppo freddo, ma domani dovrebbe andare meglio. qualcuno ti ha chiamato questo pomeriggio e proverà di nuovo più tardi. potremmo vederci dopo il lavoro, o è troppo tardi per te? i bambini giocavano fuori mentre il padre leggeva il giornale. grazie mille per il tuo aiuto, sei stato molto gentile. la maggior parte di loro non ha capito perché il maestro fosse così arrabbiato.",
    "nl": "de mensen in dit huis wisten niet wat ze ermee moesten doen. kun je me alsjeblieft zeggen waar jullie mijn spullen hebben neergezet? zij zei dat hij met de anderen voor het einde van de week terug zou komen. wij hadden dit allemaal moeten bekijken toen er nog tijd was. niemand wil op de volgende wachten, maar ik kan dat nu niet veranderen. er is iets mis met het raam en dat is al zo sinds gisteren. heeft iemand gezien wat er met hun oude auto is gebeurd? mijn zus stuurt mij elke foto van onze vakantie. als je thuis bent, laat dan de deur voor ons open. het regende, dus moesten we binnen blijven zonder veel te doen. dit werkt niet meer omdat iemand het heeft meegenomen. de buurman vraagt net wie het eten brengt en hoeveel het kost. vrijdag hebben we met de buren over de sleutels gesproken. ik denk dat we meer dan twee uur nodig hebben, omdat de weg naar de stad dicht is. weet je wanneer de winkel 's ochtends opengaat? onze buurman woont vlak bij de rivier en werkt in het ziekenhuis. ze zijn daar nog nooit geweest, hoewel iedereen het erover heeft. welke van deze zou je willen kopen? eerst hebben we de kleine kamer bekeken, daarna de keuken en de tuin. het is vandaag veel te koud, maar morgen zou het beter moeten zijn. iemand heeft je vanmiddag gebeld en probeert het later nog een keer. kunnen we elkaar na het werk zien, of is dat te laat voor jou? de kinderen speelden buiten terwijl hun vader de krant las. heel erg bedankt voor je hulp, dat was erg aardig van je. de meesten begrepen niet waarom de leraar zo boos was.",
    "pl": "ludzie w tym domu nie wiedzieli, co z tym zrobić. czy możesz mi proszę powiedzieć, gdzie położyliście moje rzeczy? ona powiedziała, że on wróci z innymi przed końcem tygodnia. powinniśmy byli to wszystko sprawdzić, kiedy jeszcze był czas. nikt nie chce czekać na następny, ale ja nie mogę tego teraz zmienić. coś jest nie tak z oknem i jest tak od wczoraj. czy ktoś widział, co się stało z ich starym samochodem? moja siostra przesłała mi wszystkie zdjęcia z naszej podróży. jeśli jesteś w domu, zostaw dla nas otwarte drzwi. padało, więc musieliśmy zostać w środku. to już nie działa, bo ktoś to zabrał. oni właśnie zapytali, kto przyniesie jedzenie i ile to kosztuje. w piątek rozmawialiśmy z sąsiadami o kluczach. po kolacji trzeba to zrobić bez pośpiechu. myślę, że będziemy potrzebować więcej niż dwie godziny, ponieważ droga do miasta jest zamknięta. czy wiesz, kiedy rano otwierają sklep? nasz sąsiad mieszka blisko rzeki i pracuje w szpitalu. oni nigdy tam nie byli, chociaż wszyscy o tym mówią. który z nich chciałbyś kupić? najpierw obejrzeliśmy mały pokój, potem kuchnię i ogród. dzisiaj jest o wiele za zimno, ale jutro powinno być lepiej. ktoś dzwonił do ciebie po południu i spróbuje jeszcze raz później. czy możemy się spotkać po pracy, czy to dla was za późno? dzieci bawiły się na dworze, a ich ojciec czytał gazetę. bardzo dziękuję za pomoc, to było bardzo miłe. większość z nich nie zrozumiała, dlaczego nauczyciel był taki zły.",
    "ru": "люди в этом доме не знали, что с этим делать. скажи мне, пожалуйста, куда вы положили мои вещи? она сказала, что он вернётся с другими до конца недели. мы должны были всё это проверить, пока ещё было время. никто не хочет ждать следующего, но я не могу сейчас это изменить. с окном что-то не так, и это так со вчерашнего дня. кто-нибудь видел, что случилось с их старой машиной? моя сестра прислала мне все фотографии из нашей поездки. если ты дома, оставь для нас открытую дверь. шёл дождь, поэтому нам пришлось остаться внутри. это больше не работает, потому что кто-то это забрал. они только что спросили, кто принесёт еду и сколько это стоит. в пятницу мы говорили с соседями о ключах. после ужина нужно сделать это не спеша. я думаю, нам понадобится больше двух часов, потому что дорога в город закрыта. ты знаешь, когда утром открывается магазин? наш сосед живёт рядом с рекой и работает в больнице. они никогда там не были, хотя все об этом говорят. какой из них ты хотел бы купить? сначала мы посмотрели маленькую комнату, потом кухню и сад. сегодня слишком холодно, но завтра должно быть лучше. кто-то звонил тебе сегодня днём и попробует ещё раз позже. можем мы встретиться после работы или это слишком поздно для вас? дети играли на улице, пока их отец читал газету. большое спасибо за твою помощь, это было очень мило. большинство из них не поняли, почему учитель был такой сердитый. этого никто не ожидал, и теперь надо подождать.",
    "uk": "люди в цьому будинку не знали, що з цим робити. скажи мені, будь ласка, куди ви поклали мої речі? вона сказала, що він повернеться з іншими до кінця тижня. ми мали все це перевірити, поки ще був час. ніхто не хоче чекати на наступний, але я не можу зараз це змінити. з вікном щось не так, і це так від учора. хтось бачив, що сталося з їхньою старою машиною? моя сестра надіслала мені всі світлини з нашої подорожі. якщо ти вдома, залиш для нас відчинені двері. йшов дощ, тому нам довелося залишитися всередині. це більше не працює, бо хтось це забрав. вони щойно спитали, хто принесе їжу і скільки це коштує. у п'ятницю ми говорили із сусідами про ключі. після вечері треба зробити це не поспішаючи. я думаю, нам знадобиться більше двох годин, тому що дорога до міста закрита. ти знаєш, коли вранці відчиняється крамниця? наш сусід живе поруч із річкою і працює в лікарні. вони ніколи там не були, хоча всі про це говорять. який із них ти хотів би купити? спочатку ми подивилися маленьку кімнату, потім кухню і сад. сьогодні занадто холодно, але завтра має бути краще. хтось телефонував тобі сьогодні вдень і спробує ще раз пізніше. чи можемо ми зустрітися після роботи, чи це запізно для вас? діти гралися надворі, поки їхній батько читав газету. дуже дякую за твою допомогу, це було дуже мило. більшість із них не зрозуміли, чому вчитель був такий сердитий. цього ніхто не очікував, і тепер треба зачекати.",
    "tr": "bu evdeki insanlar bununla ne yapacaklarını bilmiyordu. lütfen bana eşyalarımı nereye koyduğunuzu söyler misin? o, hafta sonundan önce diğerleriyle geri geleceğini söyledi. hâlâ zaman varken bütün bunları kontrol etmeliydik. kimse bir sonrakini beklemek istemiyor ama ben bunu şimdi değiştiremem. pencerede bir sorun var ve dünden beri böyle. onların eski arabasına ne olduğunu gören var mı? kız kardeşim bana gezimizin bütün resimlerini gönderdi. evdeysen kapıyı bizim için açık bırak. yağmur yağıyordu, bu yüzden içeride kalmak zorunda kaldık. birisi aldığı için artık çalışmıyor. az önce yemeği kimin getireceğini ve ne kadar tuttuğunu sordular. cuma günü komşularla anahtarlar hakkında konuştuk. akşam yemeğinden sonra acele etmeden yapmak gerekiyor. sanırım iki saatten fazlasına ihtiyacımız olacak, çünkü şehre giden yol kapalı. dükkanın sabah ne zaman açıldığını biliyor musun? komşumuz nehrin yakınında oturuyor ve hastanede çalışıyor. herkes bundan bahsetse de onlar daha önce hiç orada bulunmadı. bunlardan hangisini satın almak istersin? önce küçük odaya, sonra mutfağa ve bahçeye baktık. bugün hava çok soğuk ama yarın daha iyi olması gerekiyor. birisi bu öğleden sonra seni aradı ve daha sonra tekrar deneyecek. işten sonra buluşabilir miyiz, yoksa sizin için çok mu geç? babaları gazete okurken çocuklar dışarıda oynuyordu. yardımın için çok teşekkür ederim, çok naziktin. çoğu öğretmenin neden bu kadar kızgın olduğunu anlamadı.",
}

#: Languages in Cyrillic letters; a sentence is compared with the languages of its script.
CYRILLIC = ("ru", "uk")
LEAST_WORDS = 3
#: Least difference of the two best sizes as a share of the second best; narrower sentences stay undecided.
LEAST_MARGIN = 0.14
#: Bounds of the labelled sample: documents read (about this many, chosen by a hash of their key), sentences and characters kept of each language.
SAMPLE_DOCUMENTS, SAMPLE_SENTENCES, SAMPLE_CHARS = 8000, 600, 60_000
#: Lazy matching. Optimal parsing, from level 11 on, stores short texts as they are more often, which makes languages equal.
LEVEL = 6
#: Decided sentences a task remembers, as many are repeated.
REMEMBERED = 50_000

_HEAD = re.compile(r"^\[[^\]\n]*\] [^:\n]{1,80}: ", re.M)
_MAIL = re.compile(
    r"[\w.+-]+\s*(?:[@＠]|\(at\)|\[at\]|\s+at\s+(?=[\w-]+(?:\s+dot\s|\[dot\]|\.\w)))\s*[\w-]+(?:\s*(?:\.|\[dot\]|\(dot\)|\s+dot\s+)\s*[\w-]+)+", re.I
)
_AT = re.compile(r"[@＠]|[(\[\s]at[)\]\s]", re.I)
_NOISE = re.compile(r"(?:https?://|mailto:|www\.)\S+|\S+[@＠]\S+|[@#/]\w+|\b\w*\d\w*\b")
_MARKED = re.compile(r"[@＠#/\d]|www\.|mailto:")
_END = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+|\s*(?:[:;]-?[)(DP])(?=\s|$)\s*|\n+")
_CYRILLIC = re.compile(r"[\u0400-\u052f]")
_WORD = re.compile(r"[^\W\d_]{2,}")


def language_of(label: Column) -> Column:
    """Two-letter code of a label, ``""`` if it is missing, ``"?"`` if it names no known language."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)", 1)
    out = F.when(label.isNull() | F.trim(label).isin("", "und", "UND"), F.lit(""))
    for code, others in LANGUAGES.items():
        out = out.when(base.isin(code, *others), F.lit(code))
    return out.otherwise(F.lit("?"))


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(message number, offset, sentence) of each sentence with enough words; links, handles and numbers are cut out."""
    found = []
    heads = list(_HEAD.finditer(text))
    spans = [(m.end(), n.start() if n else len(text)) for m, n in zip(heads, [*heads[1:], None][: len(heads)], strict=True)]
    if not heads or text[: heads[0].start()].strip():
        spans.insert(0, (0, heads[0].start() if heads else len(text)))
    for number, (start, end) in enumerate(spans):
        at = start
        for cut in [*_END.finditer(text, start, end), None]:
            piece = text[at : cut.start() if cut else end]
            # An address needs one of these; most sentences have none.
            if _AT.search(piece):
                piece = _MAIL.sub(" ", piece)
            if _MARKED.search(piece):
                piece = _NOISE.sub(" ", piece)
            if len(_WORD.findall(piece)) >= LEAST_WORDS:
                found.append((number, at, piece.strip()))
            at = cut.end() if cut else end
    return found


def plain(text: str) -> str:
    """Lower case, letters and single blanks; accents are kept."""
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", text).lower().replace("i̇", "i"))
    return " " + " ".join(re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", text.replace("’", "'"))) + " "


def bare(text: str) -> str:
    """:func:`plain` without accents."""
    text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return text.replace("ı", "i").replace("ł", "l").replace("ß", "ss").replace("ø", "o")


class Compressors:
    """One compressor per language over a raw-content dictionary."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.codes = list(texts)
        self.each, self.memo = [], {}
        self.members = {c: [i for i, code in enumerate(self.codes) if (code in CYRILLIC) == c] for c in (True, False)}
        for text in texts.values():
            raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(dict_data=raw, level=LEVEL, write_content_size=False, write_dict_id=False))

    def decide(self, sentence: str) -> tuple[str, float]:
        """Best language of the sentence's script and its margin over the second best."""
        text = plain(sentence)
        if text not in self.memo:
            if len(self.memo) >= REMEMBERED:
                self.memo.clear()
            self.memo[text] = self._decide(text)
        return self.memo[text]

    def _decide(self, text: str) -> tuple[str, float]:
        data = text.encode()
        script = len(_CYRILLIC.findall(text)) * 2 > sum(map(str.isalpha, text))
        sizes = {i: len(self.each[i].compress(data)) for i in self.members[script]}
        best = min(sizes, key=sizes.__getitem__)
        second = min(s for i, s in sizes.items() if i != best)
        return self.codes[best], (second - sizes[best]) / second


def dictionary(parts: list[str]) -> str:
    """Plain and accent-free forms, the most telling text last, where matches are cheapest."""
    text = "".join(plain(p) for p in parts)
    return bare(text) + text


def seed_compressors() -> Compressors:
    return Compressors({code: dictionary([text]) for code, text in SEEDS.items()})


def sampled_sentences(documents: DataFrame, key: str, text: str, label: str) -> dict[str, list[str]]:
    """Sentences of labelled documents to which the built-in texts give the language of the label, within the bounds."""
    labelled = documents.select(F.col(text).alias("_t"), language_of(F.col(label)).alias("_l"), F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("_h"))
    known = labelled.where(F.col("_l").isin(*LANGUAGES) & F.col("_t").isNotNull())
    # A share of all labelled documents, taken where they are read instead of sorting texts.
    sample = known.where(F.col("_h") < (1 << 30) * min(1.0, SAMPLE_DOCUMENTS / max(1, known.count())))

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = seed_compressors()
        for frame in frames:
            rows = set()
            for body, code in zip(frame["_t"], frame["_l"], strict=True):
                judged = [(s, *seeds.decide(s)) for _, _, s in sentences(body) if len(s) <= 300]
                weight = Counter()
                for _, found, margin in judged:
                    weight[found] += margin
                if weight and weight[code] == max(weight.values()):
                    rows.update((code, s) for s, found, margin in judged if found == code and margin >= LEAST_MARGIN / 2)
            yield pd.DataFrame(sorted(rows), columns=["code", "s"])

    spread = sample.repartition(F.pmod("_h", F.lit(64)))
    picked = spread.mapInPandas(pick, "code string, s string").distinct()
    kept = picked.groupBy("code").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("s").alias("h"), "s"))), 1, SAMPLE_SENTENCES).alias("x"))
    return {r.code: [x.s for x in r.x] for r in kept.collect()}


def fit(documents: DataFrame, key: str, text: str, label: str) -> dict[str, str]:
    """Dictionary text of each language."""
    sampled = sampled_sentences(documents, key, text, label)
    texts = {}
    for code, seed in SEEDS.items():
        parts, room = [], SAMPLE_CHARS
        for s in sampled.get(code, []):
            room -= len(s)
            if room < 0:
                break
            parts.append(s)
        texts[code] = dictionary([seed, *reversed(parts)])
    return texts


def label_sentences(documents: DataFrame, key: str, text: str, texts: dict[str, str]) -> DataFrame:
    """One row per sentence: message number, offset, language (null if undecided), the best language in any case, and
    the margin as confidence."""
    shared = documents.sparkSession.sparkContext.broadcast(texts)
    kind = dict(documents.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Compressors(shared.value)
        for frame in frames:
            rows = []
            for k, body in zip(frame["_k"], frame["_t"], strict=True):
                for number, at, s in sentences(body):
                    code, margin = judge.decide(s)
                    rows.append((k, number, at, len(s), code if margin >= LEAST_MARGIN else None, code, margin))
            yield pd.DataFrame(rows, columns=["_k", "message_no", "start", "length", "language", "best", "confidence"])

    narrow = documents.select(F.col(key).cast("string").alias("_k"), F.col(text).alias("_t")).where("_t is not null")
    schema = "_k string, message_no long, start long, length long, language string, best string, confidence double"
    return restored_key(narrow.mapInPandas(run, schema), key, kind)


def stretches(labelled: DataFrame, key: str) -> DataFrame:
    """Runs of sentences in one language, undecided ones left out, with the mean confidence.

    A window covers the sentences of one document.
    """
    w = Window.partitionBy(key).orderBy("start")
    known = labelled.where("language is not null").withColumn("_new", F.coalesce(F.col("language") != F.lag("language").over(w), F.lit(True)).cast("int"))
    numbered = known.withColumn("stretch", F.sum("_new").over(w))
    return numbered.groupBy(key, "stretch", "language").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"),
        F.count(F.lit(1)).alias("n_sentences"), F.avg("confidence").alias("confidence"),
    )


def record_languages(documents: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    """One row per document: the language with the most text, weighted by confidence, and the mean confidence of it.

    Undecided sentences count with their low confidence, so a document of such sentences alone has a language, too; a
    document without any sentence has a null language and confidence 0.
    """
    weight = F.sum(F.col("length") * F.col("confidence"))
    per = labelled.groupBy(key, "best").agg(weight.alias("_w"), (weight / F.sum("length")).alias("_c"))
    top = per.groupBy(key).agg(F.max(F.struct("_w", "_c", "best")).alias("_top"))  # at most one row per language
    keys = documents.select(key).distinct()
    joined = keys.join(top, keys[key].eqNullSafe(top[key]), "left")
    return joined.select(keys[key], F.col("_top.best").alias("language"), F.coalesce("_top._c", F.lit(0.0)).alias("confidence"))


def document_languages(labelled: DataFrame, key: str) -> DataFrame:
    """One row per document and language with at least one decided sentence: share of its sentences and confidence."""
    per = labelled.where("language is not null").groupBy(key, "language").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.avg("confidence").alias("confidence"), F.sum("length").alias("n_chars")
    )
    return per


def missing_or_wrong(documents: DataFrame, key: str, label: str, languages: DataFrame) -> DataFrame:
    """Languages of documents whose label is missing, names a language without a sentence, or is not the only one."""
    found = languages.groupBy(key).agg(F.collect_set("language").alias("_found"))  # at most one entry per language
    named = documents.select(F.col(key), language_of(F.col(label)).alias("_named"))
    wrong = (F.size("_found") > 1) | ~F.array_contains("_found", F.col("_named"))
    return named.join(found, key).where(wrong).select(key, F.explode("_found").alias("lang"))
