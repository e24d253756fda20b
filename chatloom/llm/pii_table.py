"""The small labelled table from which the personal-data model is trained.

Lines hold slots such as ``{phone}``; each slot is filled several times with values made by rule from a seeded random
generator, which gives token rows with labels. All names, numbers and places are invented.
"""

from __future__ import annotations

import random
import re

from chatloom.llm.langid import SEEDS

#: Lines with personal data, by language; ``{place}`` and ``{code}`` are no personal data.
LINES = """
call me on {phone} after six
text {phone} when you are at the gate.
the mobile {phone} is always on.
her number is {phone} if the bot fails.
you can reach us at {phone} or at {email}
my phone: {phone}
{phone}
{phone}. {email}.
ring {phone} and ask for {name}
you can write to {email} about the export.
send the scans over to {email} please
my new mail is {email}, the old one bounces.
cc {email} when the archive is ready.
{email}
{email}. {phone}.
lol {email}
contact {email} for details
mail <{email}> or mailto:{email}
ID card no {idnum}, please keep it private
my tax number {idnum} goes on the receipt
driving licence {idnum}, expires next year.
the form wants my passport number, it is {idnum}
for the insurance they need {idnum}, that is what my social security card says.
passport {idnum} was issued last year
my national insurance number is {idnum}
licence number {idnum} and insurance file {idnum}
she lives at {address} and the bell is broken.
ship the drive to {address} thanks
please deliver the box to {address} before noon.
we moved, the flat is at {address} now.
my address is {address}.
send it to {address}
I met {name} at the meeting and got the keys.
please add {name} to the list.
{name} will bring the projector.
the refund goes to {name} not to the club.
team {name} will bring the projector
ask {name} about the keys
the invoice is for {name}, {address}
thanks to {name} for the help
{name} said the box is ready, call {phone}
deadline please add {name} to the list
ruf mich unter {phone} an, ich bin zu Hause
meine Nummer ist {phone}, bitte nach sechs anrufen
schreib bitte an {email} wegen der Dateien
meine Ausweisnummer lautet {idnum}, bitte nicht weitergeben.
meine Steuernummer ist {idnum}
das Paket soll bitte an {address} geschickt werden.
sie wohnt in {address}
der Schlüssel liegt bei {name} im Büro.
ich habe {name} beim Treffen gesehen
appelle-moi au {phone} quand tu arrives.
merci d'écrire à {email} pour les fichiers.
mon numéro de carte d'identité est le {idnum}, garde-le pour toi
il faut envoyer la boîte au {address} avant vendredi.
elle habite au {address}
les clés sont chez {name} au bureau.
j'ai vu {name} à la réunion
llámame al {phone} cuando llegues a casa
escribe por favor a {email} sobre los archivos.
mi número de identidad es {idnum}, no lo compartas.
envía la caja a {address} antes del viernes
las llaves las tiene {name} en la oficina.
позвони мне по номеру {phone} вечером
напиши пожалуйста на {email} насчёт файлов.
мой номер паспорта {idnum}, никому не показывай.
отправь коробку по адресу {address} до пятницы.
ключи сейчас у человека по имени {name} в офисе.
chiamami al {phone} dopo le sei
scrivi a {email} per i file
il mio codice fiscale è {idnum}
spedisci la scatola a {address}
le chiavi le ha {name} in ufficio
liga-me para {phone} depois das seis
escreve para {email} sobre os arquivos
o meu número de identidade é {idnum}
envia a caixa para {address}
as chaves estão com {name} no escritório
bel me op {phone} na zes uur
schrijf naar {email} over de bestanden
mijn paspoortnummer is {idnum}
stuur de doos naar {address}
de sleutels liggen bij {name} op kantoor
zadzwoń pod {phone} po szóstej
napisz na {email} w sprawie plików
mój numer dowodu to {idnum}
wyślij pudełko na {address}
klucze ma {name} w biurze
подзвони мені за номером {phone} увечері
напиши на {email} щодо файлів
мій номер паспорта {idnum}
надішли коробку на {address}
ключі зараз у {name} в офісі
beni {phone} numarasından ara
dosyalar için {email} adresine yaz
kimlik numaram {idnum}
kutuyu {address} adresine gönder
anahtarlar {name} adlı kişide
"""

#: Running prose with personal data inside, in many positions of a sentence.
PROSE = """
{name} called this morning and asked for the minutes of the last meeting.
According to {name}, the old contract ends in June.
Yesterday {name} told us that the car was sold to {name}.
The report was written by {name} and checked by {name}.
I talked to {name} about it, and she agrees with the plan.
My sister {name} moved to {place} two years ago.
We had dinner with {name} and {name} on Saturday
Is {name} coming to the party, or should we wait?
Best regards, {name}
Thanks, {name}
The doctor's name is {name}, his office is at {address}.
{name} lives at {address} with her two children.
Their office moved to {address}, next to the library.
You will find the bakery at {address}; it opens at seven.
The parcel was sent to {address} by mistake.
Meet me in front of {address} at {small}:{two}.
Since March we have rented {address}.
If anything happens, dial {phone} or write to {email}.
My new number is {phone}, please delete the old one.
Her office line is {phone} and her private one {phone}.
Fax {phone}, phone {phone}.
WhatsApp me at {phone} tonight
For bookings contact {name}, {phone}, {email}.
Questions go to {email}, complaints to {email}.
He signed up with {email} last week.
Our accountant {name} needs the tax id {idnum} by Friday.
The insurance policy {idnum} covers the damage to the roof.
My SSN is {idnum}, do not share it.
Social security: {idnum}
Her passport ({idnum}) runs out in May.
Transfer the deposit to IBAN {iban} please
the account {iban} belongs to the club
NHS number {idnum}, born in May
DNI {idnum}, CPF {idnum}, PESEL {idnum}
The driver's license {idnum} was found near the station.
Please note the new identity card number: {idnum}.
Gestern hat {name} angerufen und nach dem Vertrag gefragt.
Laut {name} ist die Sitzung auf Montag verschoben.
Unser Büro ist jetzt in der {address}.
Viele Grüße, {name}
Hier, {address} a été vendu par {name}.
Selon {name}, la réunion est annulée.
Ayer {name} nos dijo que la reunión es el lunes.
Vivimos en {address} desde marzo.
Ieri {name} ha scritto a {email} per il contratto.
Gisteren belde {name} over het contract, het nummer is {phone}.
Wczoraj {name} dzwonił w sprawie umowy.
Вчера {name} звонил по поводу договора.
"""

#: Lines that look alike without personal data.
PLAIN = """
the file is called scan_{code}.pdf and it is huge
parcel {code} left the depot
ticket {code} is still open
topic {code} has been renamed again
the build {code} passed on the second try
checksum {hex} looks right to me
order {code} was packed, invoice {code} follows
version {small}.{small}.{small} breaks the voice notes
the total was {small}.{two} coins for the boat
the ferry leaves at {small}:{two} from pier four
we meet in {place} near the fountain as usual
{place} was sunny all week
the train from {place} to {place} was late
ask @{handle} about the sticker pack
@{handle}
lol ask @{handle} about the keys
see https://files.example/a/{long} and #{long}
{club} is my favourite board game so far
team {club} is my favourite board game so far
deadline {club} won again
the {club} meets on Monday
+1
/start
/help @{handle}
#{long}
{long}
ok
On Monday we sorted {three} items at the {place} warehouse, and the receipt for {three} coins is attached.
Has anyone seen the heavy kettle that a new member moved after the {small}:{two} ferry?
The night crew photographed the tiny poster under the stairs, and {three} photos from that evening are still missing.
A volunteer from the eastern pier checked the cheap recipe card on Friday, because the {three} older copies were unreadable.
Around {small} o'clock we repaired {three} items, but the link in the topic no longer works.
If the route map is in the upper hall, leave it there as promised.
Early on Thursday the Parcel Desk moved {three} boxes to {place}.
The Lowland depot and the Harbour office close on Friday after the Monday call.
They have renamed the weekly export on the second laptop. Nobody noticed the pinned message!
My brother forwarded every photo from the trip because the server was slow :)
SHE WANTS TO KEEP THE OLD NOTES BEFORE LUNCH. PLEASE CHECK THE LIST AFTER THE UPDATE
SOMEBODY DELETED THE PINNED MESSAGE LAST TUESDAY AS WE AGREED
Ich suche den alten Bericht auf dem zweiten Gerät. Wir löschen jedes Foto von der Reise.
DER KOLLEGE FINDET DIE ALTEN NACHRICHTEN WEIL DER RECHNER LANGSAM IST
Il a renommé la liste partagée avant le déjeuner. Merci de vérifier les photos du voyage
ILS ONT RENOMMÉ LE SUJET PENDANT QUE LE TRAIN ÉTAIT EN RETARD
Ella quiere guardar los viejos mensajes. Por favor revisa la lista compartida
ELLOS HAN COPIADO TODAS LAS FOTOS DEL VIAJE
Lei vuole conservare i vecchi messaggi prima di pranzo. Qualcuno ha cancellato la lista
Ela quer guardar a mensagem fixada. Ninguém percebeu a lista compartilhada
Niemand opent de oude berichten voor de lunch. Mijn broer zoekt elke foto van de reis
Ona chce zachować stare wiadomości przed obiadem. Ktoś usunął naszą listę
Она хочет оставить старые сообщения до обеда. Кто-то удалил список после обновления
ОНИ ПЕРЕИМЕНОВАЛИ ЕЖЕНЕДЕЛЬНУЮ ВЫГРУЗКУ ПОКА ПОЕЗД ОПАЗДЫВАЛ
Хтось видалив старі повідомлення після оновлення. Мій брат переслав світлини з поїздки
Güncellemeden sonra eski mesajları sildik. Tren gecikirken listeyi kopyalamayı unuttuk
"""
#: Prose without personal data: places, brands, titles, events, dates, prices and numbers of things.
PROSE_PLAIN = """
The {things} opens again on Monday, tickets cost {small} euros.
We watched {things} and then walked home.
{things} was founded in {year} and has {three} members.
Has anyone read {things} yet?
The update of {things} is out, version {small}.{small}.
We flew from {city} to {city} in {year}.
Greetings from {city}, the weather is great.
The {city} office closes at {small}:{two} on Fridays.
{city} and {city} are twin towns since {year}.
On {date} we meet again, at {small}:{two} sharp.
The meeting of {date} was moved to {date}.
Order number {long}{three} was shipped on {date}.
Tracking id {code} says delivered.
The price went up from {three} to {long} in {year}.
ISBN 978-{small}-{two}-{long}{small}-{small} is out of print
the server 192.168.{small}.{two} is down, port {long}
chapter {small}, page {three}, line {two}
Route {two} and Highway {small} are closed near {city}.
There are {long} people living in {city}, {three} of them in the old town.
Happy Birthday and Merry Christmas to everyone!
The Prime Minister and the Board of Directors met in {city}.
He bought {small} apples, {two} pears and a melon for {three} coins.
Room {three} on floor {small} is free between {small} and {two}.
In {city} gibt es {three} Brücken und {small} Museen.
La ville de {city} compte {long} habitants.
La reunión del {date} será en {city}.
Mein Bruder sucht den Schlüssel für die Wohnung. Jemand hat die Nachricht gestern gelöscht.
Meine Schwester kauft am Dienstag neue Möbel. Der Kollege bringt das Essen zur Sitzung mit.
Ihr habt die Liste nach dem Mittagessen geändert. Niemand weiß, wo die alten Unterlagen liegen.
Bitte schließe das Fenster, der Regen kommt. Unsere Nachbarn feiern heute Abend im Garten.
Der Zug nach {city} hatte Verspätung. Die Fahrkarte kostet {small} Euro, ohne Rückfahrt.
Seit letztem Freitag steht das Fahrrad im Keller. Das Kind spielt mit dem Hund der Familie.
Wir haben das Bild vor der Abreise verschickt. Ich finde den Ordner mit den Rechnungen nicht.
Mijn zus zoekt de sleutel van de Woning. Iemand heeft Dinsdag het bericht verwijderd.
Somebody moved the Kitchen Table last Tuesday. My Brother has the spare Keys.
Last Monday the Old Library and the Post Office were closed. Nobody told us.
After the Summer Break we start the Spring Cleaning. Please bring your own Gloves.
La Semaine prochaine nous visitons le Musée. Quelqu'un a pris la Clé du Bureau.
El Lunes por la Mañana cierra el Mercado. Mi Hermana trae la Comida.
Kardeşim Salı günü mektubu aradı. Birisi eski listeyi sildi.
KTOŚ PRZENIÓSŁ STARE LISTY PO OBIEDZIE. NIKT NIE ZNALAZŁ KLUCZA DO BIURA
MUSIMY SPRAWDZIĆ WIADOMOŚCI NA DRUGIM KOMPUTERZE OD WTORKU
IEMAND HEEFT DE LIJST OP DE TWEEDE COMPUTER BEWAARD
NIEMAND WEISS WO DIE ALTEN BILDER SIND
Nessuno ha trovato l'ingresso del museo. L'autobus parte dopo l'una, dalla piazza dell'orologio.
L'imprimante de l'école ne marche pas. Quelqu'un a jeté l'ancienne affiche d'été.
O relógio da estação está parado. A senhora do mercado vende pão até ao meio-dia.
Los relojes de la estación no funcionan. Hay que pintar la puerta antes del invierno.
"""
REPEATS = 22
#: Rows of each everyday sentence.
EVERYDAY = 3
#: Share of the rows in which words of the line are replaced.
SCRAMBLED = 0.7
#: Share of the rows without personal data that are in capitals.
CAPITALS = 0.15
#: Names of many origins; those made of syllables below are added to them.
GIVEN_NAMES = tuple("""James Mary Robert Linda Michael Susan David Karen Thomas Nancy Daniel Emily Andrew Laura Peter Anna Hans Greta Jürgen
Sabine Klaus Heike Pierre Claire Luc Amélie Carlos Lucía Javier Carmen Pablo Inés João Beatriz Rui Giulia Marco Chiara Luca Sven
Ingrid Lars Astrid Pieter Femke Jan Katarzyna Piotr Agnieszka Tomasz Ivan Olga Dmitri Natalia Sergei Elena Mehmet Ayşe Mustafa Fatma
Ahmed Fatima Hassan Layla Omar Yusuf Zainab Ravi Anjali Sanjay Deepa Arjun Meera Wei Li Ming Xin Hiroshi Yuki Kenji Sakura Minh Linh
Kofi Ama Chidi Ngozi Sipho Thandi Siobhan Liam Moshe Rivka Nikos Eleni
John William Joseph Charles Christopher Matthew Anthony Mark Paul Steven Kevin Brian George Edward Samuel Noah Jack Patricia Jennifer
Elizabeth Barbara Jessica Sarah Lisa Betty Margaret Ashley Emma Olivia Sophie Charlotte Alice Maria Angela Monika Ursula Stefan Wolfgang
Matthias Martin Henrik Erik Isabel Ana Juan José Luis Miguel Francesca Antonio Giovanni Roberto Jean Marie François Nicolas Camille
Mohammed Ali Aisha Khadija Ibrahim Rahul Priya Lakshmi Alexander Viktor Tatiana Svetlana Hana Takashi Ji-woo""".split())
FAMILY_NAMES = tuple("""Smith Johnson Brown Taylor Wilson Clark Walker Wright Hughes Cooper Murphy Müller Schneider Weber Becker Hoffmann Vogel
Dubois Moreau Lefebvre Girard García Fernández Martínez Romero Silva Santos Oliveira Rossi Ferrari Bianchi Ricci Larsson Nilsson Hansen
Jensen Visser Bakker Kowalski Nowak Wójcik Ivanov Smirnov Volkova Shevchenko Yılmaz Demir Kaya Hussain Rahman Abdullah Haddad Khan Patel
Sharma Gupta Iyer Reddy Wang Zhang Chen Liu Tanaka Suzuki Watanabe Kim Park Nguyen Tran Mensah Okafor Dlamini Cohen Papadopoulos
Novák Horvat Popescu Lindqvist Jones Williams Davis Miller Anderson Moore Martin Thompson White Harris Lewis Robinson Young King Green
Schmidt Fischer Meyer Wagner Bernard Petit Roux González Rodríguez López Pérez Gómez Díaz Ferreira Pereira Costa Romano Colombo Conti
Andersson Johansson Nielsen Pedersen de Jong Jansen Lewandowski Kamiński Petrov Kuznetsov Popov Singh Kumar Das Li Zhao Yang Sato Lee""".split())
#: The digits in words.
DIGIT_WORDS = ("oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
#: Share of names made of sounds alone, and the sounds.
UNHEARD = 0.5
ONSETS = ("b", "c", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "y", "z", "br", "ch", "dr", "fr", "gr", "kh", "kr", "ph", "sh", "st", "th", "tr", "zh", "", "")
NUCLEI = ("a", "e", "i", "o", "u", "ai", "ea", "ei", "ie", "ou", "oo", "ü", "ö", "á", "é")
CODAS = ("", "", "", "", "l", "m", "n", "r", "s", "t", "ck", "ng", "nd", "rt", "ss", "th", "x", "sch")
PARTICLES = ("de", "van", "van der", "von", "di", "da", "El", "bin", "O'", "Mc", "al-")
CITIES = ("London", "Paris", "Berlin", "Madrid", "Rome", "New York", "San Francisco", "Los Angeles", "Buenos Aires", "Kuala Lumpur", "Cape Town", "Warsaw", "Vienna", "Lisbon", "Saint Petersburg", "Hong Kong", "Amsterdam", "Istanbul", "Kyiv", "Tel Aviv")
THINGS = ("Golden Gate Bridge", "Star Wars", "Red Cross", "Harry Potter", "Google Maps", "Windows Server", "National Gallery", "Grand Hotel", "City Council", "Green Party", "World Cup", "Apple Store", "Central Station", "River Museum", "Blue Note", "Final Fantasy", "Royal Opera", "Visual Studio", "Morning Post", "Night Train", "Data Science Club", "Summer School", "Open Source Summit", "Old Town Market")
SHORT_STREETS = ("St", "St.", "Rd", "Rd.", "Ave", "Ave.", "Blvd", "Ln", "Dr", "Ct", "Pl", "Sq.", "Way", "Parkway")
GIVEN = ("an", "be", "car", "dor", "el", "fay", "gil", "har", "iv", "jo", "kas", "lu", "mar", "ner", "or", "pet", "ros", "sun", "tam", "wen", "ys", "zo")
MIDDLE = ("al", "e", "i", "ric", "na", "ta", "li", "ven", "to", "ra", "le", "si")
FIRST_END = ("a", "en", "el", "in", "ia", "or", "us", "ette", "ik", "an", "y", "is")
FAMILY = ("ash", "black", "cor", "dun", "east", "far", "green", "hol", "king", "lang", "mor", "north", "oak", "pen", "quil", "ridge", "stan", "thorn", "wex", "york")
FAMILY_END = ("ley", "ton", "wick", "by", "dale", "worth", "ford", "sen", "berg", "mann", "son", "field", "combe", "gard", "stad", "land", "more")
STREETS = ("Street", "Road", "Lane", "Avenue", "Quay", "Terrace", "Drive", "Court", "Square", "Hill", "Close", "Row")
CYRILLIC_GIVEN = ("Каспан", "Вендел", "Марина", "Тамсин", "Олег", "Ирина", "Сорел", "Золтан", "Лунетта", "Харкин", "Верити", "Йорет")
CYRILLIC_FAMILY = ("Эскелюнд", "Петров", "Лазарева", "Фарроби", "Воронин", "Стейнгард", "Орлов", "Данвик", "Скальд", "Мерривонд", "Ткаченко", "Гримс")
LABELS = ("O",) + tuple(f"{p}-{k}" for k in ("email", "phone", "idnum", "address", "name") for p in "BI")


class Maker:
    """Values of each slot."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.given: set[str] = set()
        self.family: set[str] = set()

    def digits(self, pattern: str) -> str:
        return re.sub("9", lambda _: str(self.r.randrange(10)), pattern)

    def wide(self, text: str) -> str:
        """Sometimes full-width digits."""
        return "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in text) if self.r.random() < 0.06 else text

    def cased(self, text: str) -> str:
        x = self.r.random()
        return text.upper() if x < 0.1 else text.lower() if x < 0.2 else text

    def unheard(self) -> str:
        """A word with a capital that no list and no ending gives away."""
        r = self.r
        part = lambda: r.choice(ONSETS) + r.choice(NUCLEI) + r.choice(CODAS)
        return "".join(part() for _ in range(r.choice((1, 2, 2, 3)))).title() + r.choice(("", "", "a", "o", "i", "e"))

    def first(self) -> str:
        r = self.r
        x = r.random()
        if x < UNHEARD:
            return self.unheard()
        if x < UNHEARD + 0.3:
            word = r.choice(GIVEN_NAMES)
            self.given.add(word.lower())
            return word
        word = (r.choice(GIVEN) + (r.choice(MIDDLE) if r.random() < 0.6 else "") + r.choice(FIRST_END)).title()
        self.given.add(word.lower())
        return word

    def last(self) -> str:
        r = self.r
        x = r.random()
        if x < UNHEARD:
            return self.unheard()
        if x < UNHEARD + 0.3:
            word = r.choice(FAMILY_NAMES)
            self.family.add(word.lower())
            if r.random() < 0.12:
                part = r.choice(PARTICLES)
                return part + word if part[-1] in "'-c" else f"{part} {word}"
            return word
        word = (r.choice(FAMILY) + r.choice(FAMILY_END)).title()
        self.family.add(word.lower())
        if r.random() < 0.1:
            other = (r.choice(FAMILY) + r.choice(FAMILY_END)).title()
            self.family.add(other.lower())
            return f"{word}-{other}"
        return word

    def name(self, cyrillic: bool = False) -> str:
        r = self.r
        if cyrillic and r.random() < 0.6:
            return self.cased(f"{r.choice(CYRILLIC_GIVEN)} {r.choice(CYRILLIC_FAMILY)}")
        first, last, x = self.first(), self.last(), r.random()
        if x < 0.12:
            return self.cased(f"{last}, {first}")
        if x < 0.2:
            return self.cased(f"{r.choice(('Dr', 'Mr', 'Mrs', 'Ms', 'Herr', 'Frau', 'Mme', 'Prof.'))} {first} {last}")
        if x < 0.26:
            return self.cased(f"{first} {r.choice('ABCDEKLMRST')}. {last}")
        if x < 0.3:
            return self.cased(f"{first} {self.first()} {last}")
        return self.cased(f"{first}{'  ' if x > 0.95 else ' '}{last}")

    def place(self) -> str:
        r = self.r
        if r.random() < 0.3:
            return self.unheard()
        word = (r.choice(("salt", "foxhol", "umber", "tide", "hex", "kirk", "iron", "marl", "pine", "glass")) + r.choice(("by", "low", "ley", "well", "holm", "dale", "port", "cote", "stow"))).title()
        return word + r.choice(("", "", "", " Bay", " End", " Hollow", " Rise", " Mill"))

    def email(self) -> str:
        r = self.r
        first, last = self.first().lower(), self.last().lower()
        user = r.choice((f"{first}.{last}", f"{first}_{last}", f"{first}{r.randrange(1000):03d}", f"{first[0]}{last}{r.randrange(10, 99)}", f"{last}+chat", f"{last}-{first}"))
        domain = f"{r.choice(('lowmoor', 'post-kite', 'tidewell', 'inbox.quellbrook', 'saltmail', 'mail.hexby', 'kestrel-box'))}.{r.choice(('example', 'test', 'invalid', 'org', 'com', 'de'))}"
        x = r.random()
        if x < 0.08:
            return f"{user}[at]{domain.replace('.', '[dot]')}"
        if x < 0.16:
            return f"{user} at {domain.replace('.', ' dot ')}"
        if x < 0.22:
            return f"{user} (at) {domain}"
        if x < 0.28:
            return f"{user} @ {domain}"
        if x < 0.34:
            return f"{user}＠{domain}"
        if x < 0.44:
            return f"{user}@{domain}".upper()
        return f"{user}@{domain}"

    def spoken(self) -> str:
        """A number in words."""
        r = self.r
        say = lambda n: " ".join(r.choice(("oh", "zero") if d == 0 else (DIGIT_WORDS[d],)) for d in (r.randrange(10) for _ in range(n)))
        return r.choice((f"oh seven {say(2)} double oh, {r.choice(DIGIT_WORDS[1:])} hundred, {say(3)}", f"oh {say(4)} {say(3)} {say(3)}", f"{say(3)}, {say(3)}, double {say(1)} {say(2)}", f"{say(3)} {say(4)}"))

    def phone(self) -> str:
        if self.r.random() < 0.05:
            return self.spoken()
        pattern = self.r.choice((
            "+44 7799 999999", "+447799999999", "+44-7799-999999", "07799 999 999", "07799 999999", "(999) 555-9999",
            "999.555.9999", "1-999-555-9999", "+1 999 555 9999", "030/99999999", "+49 30 99999 999", "030 999999",
            "+33 1 99 99 99 99", "01 99 99 99 99", "+7 999 999-99-99", "8 (999) 999-99-99", "+39 06 9999 9999",
            "+34 699 999 999", "0044 7799 999999", "0044 7799999999", "0049 30 9999999", "00 33 1 99 99 99 99", "+1 (999) 999-9999", "999-999-9999",
            "+91 99999 99999", "+86 139 9999 9999", "+55 11 99999-9999", "(099) 9999 9999", "+61 4 9999 9999", "0999 999 999", "089 99 99 99", "06-99999999", "+48 999 999 999", "555-9999", "+90 599 999 99 99",
        ))
        return self.wide(self.digits(pattern))

    def idnum(self) -> str:
        r = self.r
        letter = lambda: r.choice("ABCDEGHKLMNPQRSTXYZ")
        pattern = r.choice((
            "99 99 999999", "99999999-A", "999.999.999-99", "999-99-9999", "999 99 9999", "AA 99 99 99 A", "AA999999A",
            "A9999999A", "A99A99A99", "999 999 9999", "9999 9999 9999", "999-99-9999", "AA 999999", "A999 9999 9999 99", "AAA99999999", "99.999.999-9", "99/999/99999", "999/9999/9999", "AAAAA999999AA9AA", "A99A99A99", "9 99 99 99 999 999 99", "99 999 999 999", "99999999999", "999999999", "AA9999999", "9999 999999", "A99999999", "99999999A",
        ))
        return self.wide(self.digits(re.sub("A", lambda _: letter(), pattern)))

    def iban(self) -> str:
        r = self.r
        text = self.digits("".join(r.choice("ABCDEFGHILMNPRSTUX") for _ in "xx") + r.choice(("99 9999 9999 9999 9999 99", "99 9999 9999 9999 9999 9999", "9999999999999999999999", "99 AAAA 9999 9999 9999 99")))
        return re.sub("AAAA", lambda _: "".join(r.choice("BCDFKLMNPW") for _ in range(4)), text)

    def date(self) -> str:
        r = self.r
        d, m, y = r.randrange(1, 29), r.randrange(1, 13), r.randrange(1990, 2030)
        return r.choice((f"{d:02d}/{m:02d}/{y}", f"{y}-{m:02d}-{d:02d}", f"{d}.{m}.{y}", f"May {d}", f"{d} June {y}", f"March {d}, {y}"))

    def code(self) -> str:
        r = self.r
        return r.choice((self.digits("T-9999"), self.digits("999-99-9999"), self.digits("9999999999"), "RX " + self.digits("99 99 99") + " C", self.digits("9999-99"), "B" + self.digits("999999")))

    def address(self, language: str) -> str:
        r = self.r
        number = f"{r.randrange(1, 300)}{r.choice(('', '', '', 'a', 'b', '/' + str(r.randrange(1, 9))))}"
        zip_code, place = self.digits("99999"), self.place()
        if language == "ru":
            street = r.choice(("Кузнечный Яр", "Рябиновая", "Тихомирский", "Садовая", "Лесной", "Морская"))
            kind, town = r.choice(("ул.", "пер.", "улица", "пр.", "пр-т", "вулиця")), r.choice(("Кедровск", "Озёрск", "Соловск", "Каменка"))
            return r.choice((f"{kind} {street}, д. {number}, кв. {r.randrange(1, 99)}, г. {town}", f"{kind} {street}, {number}, {town}", f"г. {town}, {kind} {street}, дом {number}"))
        base = self.unheard() if r.random() < 0.3 else (r.choice(FAMILY) + r.choice(FAMILY_END)).title()
        if language == "de":
            street = r.choice((f"Am {base}steg", f"{base}straße", f"{base}weg", f"{base}gasse", f"An der {base}", f"{base}platz", f"Zum {base}", f"{base}allee", f"{base}str.", f"{base} Str.", f"{base}straat", f"{base}laan"))
            if r.random() < 0.3:
                return self.cased(f"{street} {number}")
            return self.cased(f"{street} {number}, {zip_code} {place}")
        if language == "fr":
            street = f"{r.choice(('rue', 'impasse', 'allée', 'avenue', 'boulevard', 'chemin', 'quai', 'place'))} {r.choice(('', 'du ', 'de la ', 'des '))}{base}"
            return self.cased(f"{number}{r.choice((' ', ', ', ' bis '))}{street}, {zip_code} {place}")
        if language == "es":
            street = f"{r.choice(('Calle', 'Avenida', 'Plaza', 'Paseo', 'Camino', 'C/', 'Rua', 'Via', 'Viale', 'Travessa', 'ul.', 'aleja'))} {r.choice(('', 'de ', 'del ', 'Mayor '))}{base}"
            floor = r.choice(("", f", {r.randrange(1, 9)}º {r.choice(('A', 'B', 'izq.', 'dcha.'))}", ", bajo"))
            return self.cased(f"{street} {number}{floor}, {zip_code} {place}")
        if r.random() < 0.3:
            near = r.choice((base, r.choice(FAMILY_NAMES), "Main", "Park", "King", "Oak", "Church", "Mill", "Station", "Fifth"))
            ending = r.choice((r.choice(SHORT_STREETS), r.choice(STREETS)))
            side = r.choice(("", "", "", " NW", " East", " S"))
            town = r.choice((place, r.choice(CITIES)))
            letter = r.choice(("", "", "", "A", "B", "C"))
            tail = r.choice(("", "", "", f", {town}", f", {town}, {r.choice(('NY', 'CA', 'DC', 'TX'))} {zip_code}", f", {town} {zip_code}", f", apt {r.randrange(1, 40)}"))
            return self.cased(f"{r.randrange(1, 2000)}{letter} {near} {ending}{side}{tail}")
        street = f"{r.choice((base, 'Rowan', 'Lantern', 'Old Ferry', 'Thistle', 'High', base + ' Green'))} {r.choice(STREETS)}"
        code = f"{r.choice('BLMQRST')}{r.choice('XYZ')}{r.randrange(1, 9)} {r.randrange(1, 9)}{r.choice('VXQ')}T"
        flat = r.choice((f"Flat {r.randrange(1, 40)}", f"Apt {r.randrange(1, 40)}{r.choice('ABCD')}", f"Unit {r.randrange(1, 40)}"))
        return self.cased(r.choice((
            f"{number} {street}, {place}", f"{number} {street}, {place} {code}", f"{flat}, {number} {street}, {place}",
            f"{flat}, {street} {number}, {code}", f"house {number} on {street} in {place}", f"house {number} on {street} in {place}",
            f"{number} {street}", f"{number} {street}",
            f"{number} {street}, {place.upper()}", f"{street} {number}, {place}",
        )))

    def club(self) -> str:
        r = self.r
        return f"{r.choice(('Royal', 'Emerald', 'Clever', 'Dusty', 'Cosmic', 'Noble', 'Misty', 'Curious', 'Hollow', 'Quiet'))} {r.choice(('Lantern', 'Heron', 'Creme Club', 'Museum', 'Beekeepers', 'Naive Art', 'Climbers', 'Harbour'))}"

    def scrambled(self, text: str, share: float) -> str:
        """Some lower-case words of a line replaced by words that mean nothing, so that shapes count beside cue words."""
        made = lambda m: "".join(self.r.choice("bcdfglmnprstvz") + self.r.choice("aeiou") for _ in range(max(1, len(m.group()) // 2))) if self.r.random() < share else m.group()
        return re.sub(r"(?<![^\W\d_]|[@/_.])[a-zà-ÿ]{2,}(?![\w@])", made, text)

    def handle(self) -> str:
        return self.r.choice((f"{self.r.choice(('old_oak', 'poets', 'farmers', 'petal', 'kestrel'))}{self.r.randrange(100)}", f"{self.first().lower()}_{self.last().lower()}"))

    def other(self, slot: str) -> str:
        return {"small": "9", "two": "99", "three": "999", "long": "99999"}.get(slot) and self.digits({"small": "9", "two": "99", "three": "999", "long": "99999"}[slot])


def language_guess(line: str) -> str:
    if re.search("[а-яіїє]", line):
        return "ru"
    for code, marks in (("de", ("ich", "bitte", "sie ", "Laut", "Grüße", "Büro", "Gisteren", "sleutel", "stuur", "schrijf", "mijn", "der ")), ("fr", ("au ", "chez", "elle", "faut", "Hier, ", "Selon")), ("es", ("llaves", "caja", "caixa", "scatola", "chiavi", "chaves", "pudełko", "klucze", "kutuyu", "Vivimos", "Ayer", "Ieri", "Wczoraj"))):
        if any(m in line for m in marks):
            return code
    return "en"


def labelled_rows(seed: int = 11, repeats: int = REPEATS) -> tuple[list[tuple[str, list[tuple[int, int, str]]]], set[str], set[str]]:
    """(text, [(start, end, kind)]) rows, and the given and family names in them."""
    make, rows = Maker(seed), []
    split = lambda block: block.strip().split("\n")
    everyday = [x[0].upper() + x[1:] for text in SEEDS.values() for x in re.split(r"(?<=[.?!]) ", text)]
    plain = split(PLAIN) + split(PROSE_PLAIN) + everyday
    marked = split(LINES) + split(PROSE)
    for line in marked + plain:
        language = language_guess(line)
        for _ in range(repeats if line in marked else EVERYDAY if line in everyday else repeats // 2):
            chosen = [line]
            if make.r.random() < 0.5:
                chosen.insert(make.r.randrange(2), make.r.choice(plain))
            text, spans = make.r.choice(("", "", "", "lol ", "okay ", "team ")), []
            noise = make.r.random() * 0.9 if make.r.random() < SCRAMBLED else 0
            for part in chosen:
                text += " " if text and not text.endswith(" ") else ""
                for piece in re.split(r"(\{\w+\})", part):
                    slot = piece[1:-1] if piece.startswith("{") else None
                    if slot is None:
                        text += make.scrambled(piece, noise) if noise else piece
                        continue
                    value = {
                        "name": lambda: make.name(language == "ru"), "address": lambda: make.address(language), "email": make.email,
                        "phone": make.phone, "idnum": make.idnum, "place": make.place, "code": make.code, "club": make.club,
                        "handle": make.handle, "iban": make.iban, "date": make.date, "year": lambda: str(make.r.randrange(1850, 2030)),
                        "city": lambda: make.r.choice(CITIES), "things": lambda: make.r.choice(THINGS), "hex": lambda: f"{make.r.getrandbits(64):016x}",
                    }.get(slot, lambda: make.other(slot))()
                    kind = "idnum" if slot == "iban" else slot
                    if kind in ("name", "address", "email", "phone", "idnum"):
                        spans.append((len(text), len(text) + len(value), kind))
                    text += value
                if make.r.random() < 0.5 and text[-1].isalnum():
                    text += make.r.choice((".", "!", "?", " :)"))
            if not spans and make.r.random() < CAPITALS:
                text = text.upper()
            rows.append((text, spans))
    return rows, make.given, make.family
