"""The labelled table from which the personal-data tagger is trained.

Sentences are written for this purpose, with slots in braces; a slot's type
labels its tokens.  Names, numbers and addresses are invented and filled in by
rule.  Everything outside slots is labelled as no personal data.
"""

from __future__ import annotations

import random

# Given names, street words, civilities.
GIVEN = (
    "adèle agathe agnès aïcha alain albert alexandre alice alix aline amadou amandine amélie amina anaïs andré anne annick antoine antonin apolline ariane armand arnaud arthur astrid aude audrey aurélie aurélien aurore axel "
    "baptiste barbara barnabé bastien basile béatrice benjamin benoît bérénice bernard bertrand brigitte bruno camille capucine carine carole caroline cécile céline charles charlotte chantal christian christine christophe claire clara claude claudine clélia clémence clément cléo clothilde colette constance corentin corinne cyril damien daniel david delphine denis denise diane didier dominique dorothée "
    "édith édouard éléonore élisabeth élise élodie éloïse émile émilie emma emmanuel éric estelle esther étienne eugène eva évelyne fabien fabrice faustine fatima fatou félix fernand firmin flavie florence florian françois françoise frédéric fulgence gabriel gaëlle gaspard gauthier geneviève georges gérard germain ghislaine gilbert gilles ginette gisèle grégoire guillaume gustave guy hamza hélène henri hervé hippolyte honorine hortense hugo hugues idriss ibrahim inès irène iris isabelle isaure ismaël "
    "jacqueline jacques jean jeanne jérémie jérôme joël joëlle jonathan joseph josette josiane jules julie julien juliette justine karim karine khadija laure laurence laurent lazare léa léandre léon léonie léopold lila line lionel lise loïc louane louis louise lucas lucie lucien lucile ludivine ludovic lydie madeleine maëlle malik manon marc marcel margaux margot marguerite marie marine marion marius martin marthe martine mathieu mathilde maud maurice maxime mehdi mélanie michel michèle mireille mohamed monique morgane moussa nadège nadia nathalie nathan nicole nicolas ninon noé noémie norbert octave odette odile olivier omar ophélie oscar pascal pascale patrice patricia patrick paul paule paulette pauline perrine philippe pierre prosper quentin rachid raoul raphaël raymond rebecca régine rémi renaud rené renée robert robin rodolphe roger roland romain rosalie roxane sabine sabrina salomé samir samuel sandrine sarah sébastien ségolène séraphin serge simon simone sofia solange solène sonia sophie stéphane stéphanie suzanne suzette sylvain sylvaine sylvie tanguy tatiana théo théodore thérèse thibault thierry thomas timothée tristan ulysse urbain valentin valérie véronique victoire victor victorine vincent violette virginie viviane william xavier yann yannick yasmina yves yvette yvonne zacharie zoé lise marc claire john james mary susan peter alan ruth george helen"
).split()
STREETS = "rue avenue av boulevard bd chemin impasse allée place quai route cours square sentier passage faubourg voie ruelle esplanade rond-point lotissement résidence".split()
CIVILITIES = "m mr mme mlle madame monsieur mademoiselle dr pr docteur professeur docteure maître mrs ms miss".split()

# Written for training. Slots: {NOM} {FAM} {INI} {TEL} {MEL} {ID9} {IPP} {PAS} {CNI} {ADR} {ADRV} {ADE};
# neutral fillers: <ville> <med> <n> <n2> <d1> <lot> <proto> <maladie> <eponyme> <fonction> <ini>.
POSITIVE = """
Dossier au nom de {NOMI}, transmis par le cabinet.
Dossier archivé au nom de {NOMI} depuis mars.
Identité relevée à l'accueil : {NOMI}, carte présentée.
Identité vérifiée : {NOM}, bracelet posé.
Présents lors de l'appel : {NOM} et {NOM}.
Étaient présents {NOM} et {NOM} ce matin.
Le patient dit s'appeler {NOM} et habiter le quartier.
La patiente dit s'appeler {NOM} et vivre seule.
Appel passé par {NOM}, qui rentre du travail.
Appel passé par {NOM} depuis la pharmacie.
Appel passé par {NOM}.
Les clés sont chez {NOMI} (voisinage) et l'ordonnance chez {NOM}.
Le chien est gardé chez {NOM} pendant le séjour.
Transmission rédigée puis signée {INI}.
Note relue et signée {INI} ce soir.
Son voisin, {NOM}, l'accompagne et répond aux questions.
Sa fille, {NOM}, l'accompagne et répond aux questions.
Son aidant, {NOM}, a rappelé à midi.
La personne de confiance, {NOM}, l'accompagne et répond aux questions.
Sa tutrice, {NOM}, reste joignable.
Lettre rédigée puis signée {INI}.
Ordonnance signée {INI}. Elle repart à pied.
The caller gives the name {NOM} for the file.
Home address: {ADE}.
Collected from {ADE}.
Lives at {ADE} with a friend.
Address on file: {ADE}, phone {TEL}.
N° SS : {ID9}.
{NOM}, présent à l'accueil, a tout vu.
{NOM} a signé la décharge.
{NOM} dort mal depuis la sortie.
{NOM} refuse le traitement proposé.
Mme {FAM} précise que tout a débuté au réveil.
Mlle {FAM} demande à rentrer chez elle.
Mademoiselle {FAM} précise que le repas est passé.
Madame {FAM} est connue du service.
madame {FAM} attend ses résultats.
M. {FAM} arrive en ambulance.
M. {FAM} refuse d'abord l'examen.
Monsieur {FAM} est adressé par son médecin traitant.
monsieur {FAM} est adressé par son médecin traitant.
Mr {FAM} est adressé par son infirmière.
Mme {INI} confirme les horaires de prise.
M. {INI} confirme la date du vaccin.
Vu par le Pr {FAM} dans la nuit.
Vu par le Dr {FAM} en salle de déchocage.
Vu par le Pr {FAM}. Une coiffeuse attend son tour.
Vu par le docteur {FAM} hier.
Rappeler au {TEL}. Numéro de sécurité sociale {ID9} vérifié.
Avis pris auprès du docteur {FAM} en salle de déchocage.
Avis pris auprès du professeur {FAM} dans la nuit.
Compte rendu dicté par le Dr {FAM}.
Courrier dicté par le docteur {NOM} hier.
Dr {FAM} was seen by the nurse on call.
Dr {FAM} agreed to the transfer.
Mr. {FAM} was seen by the nurse on call.
Mrs {FAM} arrived by ambulance.
Next of kin: {NOM}, informed at noon.
The call was made by {NOM} from the office.
{NOM} signed the discharge form.
Personne à prévenir : {NOM} ({TEL}).
Personne à prévenir : {NOM}.
Rappeler au {TEL}.
Rappeler la fille au {TEL} avant midi.
Joignable au {TEL} après 18 h.
Tél.:{TEL} (épouse).
Tél. : {TEL} (fils).
Portable {TEL}, répondeur plein.
Mobile: {TEL}.
Numéro laissé par l'entourage : {TEL}.
En cas d'aggravation, prévenir le {TEL} sans attendre.
Reach the sister at {TEL}.
Phone {TEL} after six.
Fax du cabinet {TEL}.
Courriel : {MEL}, sans réponse ce jour.
Contact <{MEL}> noté au dossier.
Demande reçue de {MEL} hier soir.
Le médecin écrit depuis {MEL} pour avoir l'avis.
Les résultats sont à envoyer à {MEL}.
Results go to {MEL} once ready.
Write to {MEL} once ready.
Mail de la famille : {MEL}.
Numéro de sécurité sociale {ID9} vérifié.
Assuré sous le {ID9}.
NIR {ID9}.
N° de sécurité sociale : {ID9}, carte lue.
IPP n° {IPP} retrouvé dans l'ancien dossier.
IPP {IPP} retrouvé dans l'ancien dossier.
Identifiant patient {IPP} retrouvé dans l'ancien dossier.
Hospital number {IPP} was checked.
Passeport n° {PAS} présenté à l'accueil.
Passeport {PAS} présenté à l'accueil.
Passport {PAS} was shown at the desk.
Carte d'identité {CNI} photocopiée.
Carte d'identité n° {CNI} scannée.
CNI {CNI} présentée.
Pris en charge au {ADR} par les secours.
Adresse de sortie {ADR}.
L'équipe se rend au {ADR}, troisième étage.
Chute devant le {ADR}, témoins partis.
Le pilulier est livré {ADR} chaque lundi.
Domicile : {ADR}.
Habite {ADR} avec ses parents.
Il demeure {ADR} depuis dix ans.
Lives at {ADR} with a cousin.
Trouvé inconscient au {ADR}.
Ambulance envoyée {ADR}, porte bleue.
Logée provisoirement au {ADR}.
""".strip().split("\n")
NEGATIVE = """
Madame <ini>., mère de l'enfant, décrit une maladie de <eponyme> familiale.
Monsieur <ini>. est déjà venu en <an>.
Mme <ini>. est déjà venue en <an>.
M. <ini>. attend un rendez-vous depuis <n> jours.
Mme [PERSON] est suivie pour un syndrome de <eponyme>.
M. [NOM] est revu au <n>e jour sous <med>.
Le signe de <eponyme> est recherché et trouvé douteux du côté du genou droit.
Le test de <eponyme> modifié par <eponyme> reste positif à <n> secondes.
Le score <eponyme>-<eponyme> classe ce tableau au rang <n> sur 30.
La maladie de <eponyme>, évoquée en <an>, n'a jamais été établie.
Selon l'échelle de <eponyme>, le score frôle <n> points à l'arrivée.
The sign of <eponyme> is doubtful near the neck.
The <eponyme> scale reaches <n> points on arrival.
Le <maladie> reste l'hypothèse principale.
Le flacon porte le lot <lot> et la mention stérile.
Le pacemaker de série <lot> est contrôlé.
Le dispositif numéro <n7> a été réglé la veille par un ami.
Le moniteur numéro <n7> a été changé la veille par la directrice.
Le boîtier numéro <n7> a été remplacé la veille par son gendre.
Le capteur n° <n7> a été remplacé la veille par sa mère.
Le protocole <proto> est appliqué.
The pump with serial <lot> was checked.
Le dossier <n4>-<n3> mentionne une apnée du sommeil et une allergie à <med>.
La fiche <n4> décrit la conduite à tenir devant une fièvre.
Tombé dans la rue près de la place du marché de <ville>.
Il reste <n> places en salle d'attente, près du quai de déchargement.
Les troubles ont débuté au bord de la route, devant une boutique de <ville>.
Le patient vit seul à <ville>, dans un studio de <n> mètres carrés au <n>e étage.
Une boulangère de <ville>, <n> ans, est amenée aux urgences pour toux grasse et entorse.
Un maçon de <n> ans, suivi depuis douze ans au centre de <ville> pour une affection mal étiquetée, revient comme chaque trimestre ; le dossier commun est repris.
Aucun voyage récent n'est noté hormis <n> jours à <ville> en juillet.
On retient une goutte et un reflux depuis <an>, traités à <ville>.
On comprend que fatigue et toux s'étaient succédé durant le séjour à <ville>.
Le conjoint garde <n> boîtes vides de <med> et une ordonnance froissée de <ville>.
Deux tubes ont été envoyés à <ville>, l'un pour <med>, l'autre pour la culture.
Le dosage de <med> revient à <d1> mg/l, soit <n> % de la cible.
Le patient prend chaque jour <med> (<n> mg) et, par périodes, <med> à la dose de <n3> mg.
L'évolution sous <med> puis <med> est marquée par une stabilité au bout de <n> jours.
Une allergie à <med> est signalée avec une douleur sourde en <an>.
L'interrogatoire ne trouve ni une goutte ni prise récente de <med>.
Quatre comprimés de <med> avalés au volant n'ont rien changé à la fièvre.
Son métier l'expose aux vapeurs de <med> depuis <an>, gants portés <n> % du temps.
Le cardiologue propose <med> en perfusion de <n> jours et une surveillance du coude droit.
Un premier traitement par <med> pendant <n> jours avait donné une rechute.
Le bilan de mars comportait ferritine <n3> µg/l, TSH <d1> mUI/l et sodium <n3> mmol/l.
La numération montre <d1> G/l de leucocytes et une CRP à <n3> mg/l.
Adressé par le cardiologue, un facteur de <n> ans décrit toux grasse et une contracture.
Adressée par l'interne de garde, une potière de <n> ans présente vertiges rotatoires et une voussure.
À <h> h <n>, sa voisine téléphone pour un libraire de <n> ans pris de sueurs nocturnes au marché.
À <h> h <n>, l'échographie abdominale pratiquée en urgence retrouve des calcifications.
Les signes ont débuté un mardi vers <h> h <n> au lycée, sous la forme d'une gêne tolérable.
Pendant la nuit du <n> juin, trois réveils pour douleur ont été comptés.
Une consultation auprès du neurologue est fixée le <n> juin.
Son gendre a compté <n> mouvements respiratoires avant l'appel, puis toux grasse.
Sa petite-fille rapporte un épisode similaire en mai <an>, calmé après <n> jours de repos.
Un collègue insiste : otalgie n'était jamais arrivée avant mai <an>.
La fréquence cardiaque est à <n3> par minute, la température à <d1> °C et la saturation à <n> %.
La marche sur <n3> mètres déclenche fatigue et une contracture.
La créatinine s'élève à <n3> µmol/l contre <n3> le mois précédent.
La cicatrice mesure <n> mm, ancienne de <n> mois, bordée par une rougeur diffuse.
Le poids est passé de <n> à <d1> kg de moins en <n> semaines.
Sous oxygène à <d1> litres, les lèvres se recolorent en <n> secondes.
Il avait refusé le vaccin en <an> par crainte d'une fièvre comme celle de <d1> °C en avril.
Un rappel est convenu dans <n> minutes si toux grasse réapparaît.
Le patient est gardé en observation <n> heures.
Il existe aussi un souffle discret près du flanc droit, une rougeur diffuse et une angoisse à l'effort.
L'examen note une masse mobile au niveau du pied gauche, sans autre anomalie notable.
Un drain a été posé au genou droit puis retiré au bout de <n> heures.
Rien n'explique cette fatigue, sinon <n> jours de jeûne et une chaleur de <n> degrés.
Une corde, des lunettes brisées et du sang séché ont été trouvés à la piscine.
Une allure ralentie, le teint gris et une pâleur cutanée frappent le chirurgien.
La douleur, cotée <n> sur 100, est lancinante et descend vers la nuque.
Quelle conduite retenez-vous dans ce contexte de palpitations ?
Énoncé. Adressé par le dermatologue, un menuisier de <n> ans décrit une otalgie.
Observation. Une fleuriste de <n> ans vient pour fièvre.
Contexte : Un ami rapporte un malaise avec chute.
Histoire. La patiente, couturière, appelle le centre.
Question. Quel examen demandez-vous ?
[Dossier progressif] Un routier de <n> ans appelle pour essoufflement croissant depuis <n> jours.
Cas clinique : une bibliothécaire de <n> ans vient pour céphalées en casque depuis <n> jours.
A retired cook from <ville>, aged <n>, is brought in with night sweats and wet cough.
Daily treatment is <med> (<n> ml) with occasional <med> at <n3> mg.
An allergy to <med> with numbness was recorded in <an>.
Sodium was <n3>, ferritin <n3> and TSH <d1> in March.
Heart rate is <n3> per minute, temperature <d1> C and saturation <n> percent.
Symptoms began on a Monday around <h>:<n> in the kitchen with a dull discomfort.
The cardiologist suggests <med> for <n> hours and checks of the left elbow.
On day <n>, the brain scan shows nothing unusual of about <n> mm.
""".strip().split("\n")

_ONSET = "b br bl c ch cl cr d dr f fl fr g gr h j l m n p pl pr qu r s t tr v".split()
_NUCLEUS = "a e i o u ou au an en on in é ai oi".split()
_FAMILY_END = "ard aud ot et in eau ier er ez ac as is oux al el eul ert ain ois ange and ron lin net tel sec vert quet".split()
_TOWN_START = "Saint- Pont- Mont Ville Beau Roche Haute Font Clair Bois Val Châtel Neuf Puy La Le".split()
_TOWN_END = "ville court bourg gnac nac zac gny lieu heim vic ac ans ay eux ières vande benoux".split()
_DRUG_END = "mycine zole pril tidine oxane amil azel étol focine uvar idrex ipan osine ynol orbe onium statine".split()
_EPONYM = "ski mann berg vic lène son thier let lac ric kado sen er in sone evelt".split()
_STREET_NAMES = "des Tilleuls-Gris|du Vieux-Lavoir|de la Croix-Penchée|des Sabotiers-Noirs|du Chêne-Creux|de l'Étang-Perdu|des Alouettes|de la Source|du Four-Banal|des Lanternes|de la République|Victor Hugo|du Moulin|des Trois-Meuniers|Jean Jaurès|de la Gare|du Général-Roux|de l'Église|des Lilas|Pasteur|du Puits-Fendu|de la Grange-Ronde|des Cordiers-Bleus|aux Herbes"

_ENGLISH_START = "Ash Oak Brook Mill Thorn Elder Fern Hazel Marsh Bell Raven Linden Cinder Harrow Cobble Wind Lark Copper".split()
_ENGLISH_END = "field well ford gate wood dale ham bury leigh side more croft worth bank".split()
_ENGLISH_STREETS = ["Street"] * 4 + ["Road"] * 4 + "Avenue Lane Drive Close Way Court Place Square Terrace Crescent Gardens Row Hill Grove Walk St Rd Ave".split()


class Filler:
    """Invented values for the slots, from one seed."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self, syllables: int) -> str:
        return "".join(self.r.choice(_ONSET) + self.r.choice(_NUCLEUS) for _ in range(syllables))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def family(self) -> str:
        one = (self.word(self.r.choice((1, 1, 2))) + self.r.choice(_ONSET[:20]) + self.r.choice(_FAMILY_END)).capitalize()
        return one if self.r.random() < 0.75 else one + "-" + (self.word(1) + self.r.choice(_ONSET) + self.r.choice(_FAMILY_END)).capitalize()

    def given(self) -> str:
        one = self.r.choice(GIVEN).capitalize()
        return one if self.r.random() < 0.9 else one + "-" + self.r.choice(GIVEN).capitalize()

    def town(self) -> str:
        start = self.r.choice(_TOWN_START)
        end = self.r.choice("aeiou") + self.r.choice(_ONSET[:12]) + self.r.choice(_TOWN_END)
        return start + end if not start.endswith("a") and start != "Le" else start + " " + end.capitalize()

    def phone(self) -> str:
        r = self.r
        pairs = [self.digits(2) for _ in range(4)]
        sep = r.choice([" ", " ", ".", "-", ""])
        head = r.choice(["0{}", "0{}", "+33 {}", "+33{}", "0033 {}", "+33 (0){}", "(0{})"]).format(r.choice("1234567"))
        if sep == "" and head.startswith("+33 "):
            sep = " "
        return r.choice([head + sep + sep.join(pairs)] * 6 + [f"+44 20 {self.digits(4)} {self.digits(4)}", f"020 {self.digits(4)} {self.digits(4)}", f"+32 4{self.digits(2)} {' '.join(pairs[:3])}"])

    def mail(self) -> str:
        r = self.r
        low = lambda s: s.lower().replace("é", "e").replace("è", "e").replace("ï", "i").replace("ô", "o")
        g, f = low(self.given()), low(self.family())
        user = r.choice([f"{g}.{f}", f"{f}_{g}", f"{g[0]}{f}", f"{f}-{g[0]}", f"{g}{self.digits(2)}", f"{g}.{f}+{r.choice(['suivi', 'info'])}"])
        host = r.choice(["clinique", "courriel", "boite-sante", "foyer", "postier", "mail.nord", "messagerie", "hopital-sud", "cabinet"]) + "." + r.choice(["fr", "com", "test", "example", "invalid", "org", "net"])
        return user + r.choice(["@"] * 6 + ["[at]", " (at) ", " [at] ", "(at)", " arobase ", " at "]) + host

    def address(self) -> str:
        r = self.r
        no = str(r.randrange(1, 220)) + r.choice(["", "", "", " bis", " ter", " B"])
        street = r.choice(STREETS[:13] + ["av.", "bd"])
        out = no + r.choice([" ", " ", ", "]) + street + " " + r.choice(_STREET_NAMES.split("|"))
        return out + r.choice(["", "", ", {} {}", " {} {}", " - {} {}"]).format(self.digits(5), self.town())

    def english_address(self) -> str:
        r = self.r
        no = str(r.randrange(1, 220)) + r.choice(["", "", "", "A", "b"])
        name = r.choice(_ENGLISH_START) + r.choice(_ENGLISH_END)
        out = no + r.choice([" ", " ", " ", ", "]) + r.choice(["", "", "", "Old ", "Upper "]) + name + " " + r.choice(_ENGLISH_STREETS)
        return out + r.choice(["", ", {}", ", {}"]).format(self.town())

    def slot(self, kind: str) -> tuple[str, str]:
        r = self.r
        if kind == "NOM":
            return f"{self.given()} {self.family()}", "nom"
        if kind == "NOMI":
            f = self.family()
            return r.choice([f"{self.given()} {f}", f"{f} {self.given()}", f"{f.upper()} {self.given()}"]), "nom"
        if kind == "FAM":
            return r.choice([self.family()] * 4 + [self.family().upper()]), "nom"
        if kind == "INI":
            return f"{r.choice('ABCDEFGHIJLMNOPRSTVYÉ')}. {self.family()}", "nom"
        if kind == "TEL":
            return self.phone(), "telephone"
        if kind == "MEL":
            return self.mail(), "courriel"
        if kind == "ID9":
            p = [r.choice("12"), self.digits(2), f"{r.randrange(1, 13):02d}", self.digits(2), self.digits(3), self.digits(3), self.digits(2)]
            return r.choice([" ", " ", ""]).join(p), "identite"
        if kind == "IPP":
            return r.choice(["00", "0", ""]) + self.digits(8), "identite"
        if kind == "PAS":
            return self.digits(2) + "".join(r.choice("ABCDFKTVXZ") for _ in "..") + self.digits(5), "identite"
        if kind == "CNI":
            return r.choice([self.digits(4) + "".join(r.choice("QWXZKT") for _ in "..") + self.digits(6), self.digits(12), "X" + self.digits(4) + "RT" + self.digits(3)]), "identite"
        if kind == "ADE":
            return self.english_address(), "adresse"
        return self.address(), "adresse"

    def neutral(self, name: str) -> str:
        r = self.r
        return {
            "ville": self.town, "med": lambda: (self.word(2) + r.choice(_DRUG_END)).capitalize(), "n": lambda: str(r.randrange(1, 95)), "an": lambda: str(r.randrange(1994, 2026)),
            "n3": lambda: str(r.randrange(100, 999)), "n4": lambda: self.digits(4), "n7": lambda: self.digits(7), "d1": lambda: f"{r.randrange(1, 60)},{r.randrange(10)}", "h": lambda: str(r.randrange(24)),
            "lot": lambda: self.digits(r.choice((9, 10, 11))), "proto": lambda: "".join(r.choice("ABNXZ") for _ in "..") + "-" + self.digits(4) + "-" + self.digits(3),
            "eponyme": lambda: (self.word(r.choice((1, 2))) + r.choice(_EPONYM)).capitalize(), "maladie": lambda: "syndrome de " + (self.word(1) + r.choice(_EPONYM)).capitalize(), "ini": lambda: r.choice("ABCDFGHJLMNPRSTY"),
        }[name]()


def _fill(template: str, f: Filler) -> list[tuple[str, str]]:
    """Pieces of a filled sentence with their labels ("" for none)."""
    out, i = [], 0
    while i < len(template):
        close = {"{": "}", "<": ">"}.get(template[i])
        j = template.find(close, i) if close else -1
        name = template[i + 1 : j] if j > 0 else ""
        if close == "}" and j > 0:
            out.append(f.slot(name))
            i = j + 1
        elif close == ">" and name.isalnum() and name.islower() or (close == ">" and name in ("n3", "n4", "n7", "d1")):
            out.append((f.neutral(name), ""))
            i = j + 1
        else:
            out.append((template[i], ""))
            i += 1
    return out


def labelled_texts(n: int, seed: int = 11, fifth: int | None = None, held_out: bool = False) -> list[list[tuple[str, str]]]:
    """``n`` short texts as pieces with labels: two to four sentences each, some
    in capitals or without accents.  With ``fifth`` (0 to 4), that fifth of the
    sentences is left out or, ``held_out``, alone used."""
    import unicodedata

    f = Filler(seed)
    positive, negative = ([t for k, t in enumerate(table) if fifth is None or (k % 5 == fifth) == held_out] for table in (POSITIVE, NEGATIVE))
    out = []
    for k in range(n):
        some = [positive[k % len(positive)]] + [f.r.choice(negative) for _ in range(f.r.choice((1, 1, 2)))]
        if f.r.random() < 0.3:
            some.append(f.r.choice(positive))
        f.r.shuffle(some)
        pieces: list[tuple[str, str]] = []
        for s in some:
            if pieces:
                pieces.append((f.r.choice([" ", " ", " ", "\n", "  "]), ""))
            pieces += _fill(s, f)
        how = f.r.random()
        if how < 0.15:
            pieces = [(t.upper(), y) for t, y in pieces]
        elif how < 0.3:
            pieces = [("".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)), y) for t, y in pieces]
        out.append(pieces)
    return out
