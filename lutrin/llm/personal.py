"""Personal information inside free text (problem 10): find it and replace it by typed pseudonyms.

Numbers are validated (French phone plan, key of the social security number) and, like birth dates, permuted
inside their own format by a keyed Feistel network, so equal values get equal pseudonyms in every document
and different values never meet. Names, e-mail and postal addresses get a keyed number in their placeholder.

Names are told by their context: after a title, as initial and surname, and beside a word that the
collection shows to be a given name or a surname. That evidence is counted over all texts (`evidence`,
`lexicon`): surnames stand alone after titles and initials, given names beside several surnames, and what
is also written in small letters or after an article is no name. A list of French given names only helps
where a collection is too small to show them.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import logging
import os
import re
import secrets
import unicodedata
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.plans.scale import written

logger = logging.getLogger(__name__)
#: Words of the lexicon handed to every worker (some 100 bytes each); a larger one is joined to the rows.
MOST_WORDS = 1_000_000
#: Distinct words that a worker counts before it hands them on.
FLUSH = 200_000

# Words before a name, street types, words that open a sentence or line after a detail.
TITLES = "M. Mme Mlle Mr Mrs Ms Dr Me Monsieur Madame Mademoiselle Maître Docteur Messieurs Mesdames".split()
STREETS = (
    "rue avenue av. av boulevard boul. bd bd. blvd place pl. impasse imp. quai allée allées all. square sq. chemin ch. che. "
    "passage pass. route rte rte. cours villa voie cité sentier ruelle esplanade faubourg fg résidence promenade montée traverse venelle mail rond-point"
).split()
ENGLISH_STREETS = "Street Road Avenue Lane Drive Square Place Way Court".split()
OPENERS = (
    "Le La Les L Un Une Des Du De D En Au Aux À A Ce Cet Cette Ces Il Elle Ils Elles On Je J Nous Vous Tu Y Par Pour Dans Sur Sous Sans Si Sont Est Avec Après Avant Chez "
    "Quand Lorsque Depuis Toute Tout Toutes Tous Selon Sauf Hors Contre Entre Vers Tél Tel Téléphone Contact Cordialement Sincèrement Bien Merci Copie Observation Pièce "
    "Dossier Domicile Référence Reçu Rappeler Signé Ratio Permis Article Chapitre Section Annexe Voir Avis Objet Madame Monsieur Mme M Me Mlle Maître Mr Mrs Ms Dr Docteur "
    "Q R The An In At On From Under Rule About Please Phone Call Submitted Neither No This That These It He She We You They By Of Page Lot Plan Parcelle Secteur Zone "
    "Implantation Hauteur Emprise Aspect Clôtures Toitures Desserte Stationnement Espaces Limites Destinations Performances Dispositions LS BRS UG UV UGSU PLU"
).split()
GIVEN = (
    "Adrien Agathe Alain Albert Alexandre Alice Aline Amandine Amina Anaïs André Anne Antoine Arnaud Arthur Aurélie Bastien Béatrice Benoît Bernard Brigitte Bruno Camille Caroline "
    "Catherine Cécile Céline Charles Charlotte Chloé Christian Christine Claire Claude Clémence Corentin Daniel David Delphine Denis Didier Dominique Édouard Élise Élodie Emma "
    "Emmanuel Éric Étienne Eva Fabrice Fatou Florence François Françoise Frédéric Gabriel Gaspard Georges Gérard Gilles Guillaume Hélène Henri Hugo Inès Isabelle Jacques Jean "
    "Jeanne Jérôme Joseph Julie Julien Karim Laura Laurent Léa Léo Livia Louis Louise Lucas Lucie Lucien Maëlle Manon Marc Margaux Marie Martin Mathilde Mehdi Michel Mohamed "
    "Monique Nadia Nathalie Nicolas Noémie Octave Odile Olivier Pascal Patrick Paul Philippe Pierre Quentin Raphaël Rémi René Robert Romain Salomé Samira Sandrine Sarah Sébastien "
    "Serge Simon Solène Sophie Stéphane Sylvie Théo Thierry Thomas Valérie Véronique Victor Vincent Virginie Wilfried Xavier Yanis Yann Yves Zélie Zoé Jean-Loup Marie-Aude"
).split()
# Common French given names besides, written down from general knowledge, not from the tables; words that also open a sentence or name a place are left out.
MORE_GIVEN = (
    "Abdel Abdelkader Abdellah Abel Achille Adam Adama Adeline Adil Adrian Adrienne Adèle Agnès Ahmed Aimée Alan Alban Albane Alberte Alberto Aldo Alessandro Alexandra Alexis "
    "Alfred Ali Alicia Alison Alix Alphonse Amadou Amaury Aminata Amine Amir Amira Amélie Ana Anastasia Anatole Anaëlle Andréa Andrée Angelo Angèle Angélina Anissa Anita Anna "
    "Annabelle Annette Annick Annie Anouk Anthony Antoinette Anton Antonin Antonio Apolline Ariane Aristide Arlette Armand Armande Armel Armelle Arsène Assia Astrid Aubin Aude "
    "Audrey Augustin Augustine Aurélia Aurélien Axel Axelle Aymeric Ayoub Aziz Aïcha Baptiste Barbara Barnabé Barthélemy Benjamin Bernadette Bernardo Berthe Bertrand Bilal "
    "Blandine Boris Boubacar Brahim Brice Bryan Bénédicte Bérangère Bérénice Caleb Calixte Camélia Candice Carine Carla Carlos Carmen Carole Carolina Cassandra Cathy Chantal "
    "Charline Charlène Christel Christelle Christiane Christophe Christopher Cindy Clara Clarisse Claudette Claudia Claudie Claudine Clothilde Clotilde Clovis Clément "
    "Clémentine Cléo Colette Coline Corinne Cyprien Cyril Cyrille Cédric Célestin Célestine Célia Célian Damien Daniela Danielle Danièle Dany Daphné Dario Deborah Denise Diana "
    "Diane Diego Dimitri Djamel Djibril Donatien Dora Dorian Doriane Dorothée Driss Dylan Edgar Edith Edmond Edmonde Edwige Eliott Elsa Elvire Emmanuelle Emmy Enzo Erika "
    "Ernest Erwan Estelle Esther Estéban Ethan Eugène Eugénie Evan Fabian Fabien Fabienne Fabio Fadila Fanny Fanta Farid Farida Fatiha Fatima Fatoumata Faustine Ferdinand "
    "Fernand Fernande Fernando Flavie Flavien Florent Florentin Florian Florine Francine Francis Francisco Francisque Franck Frank Fred Freddy Frédérique Félicie Félix Gabin "
    "Gabrielle Gaston Gauthier Gautier Gaétan Gaël Gaëlle Geneviève Geoffrey Geoffroy Georgette Gervais Ghislain Ghislaine Gilbert Gilberte Gina Ginette Gisèle Giuseppe "
    "Gontran Grégoire Grégory Guilhem Gustave Guy Guénolé Gwenaël Gwenaëlle Gwendoline Gérald Géraldine Habib Hadrien Hakim Halima Hamid Hamza Hannah Hassan Henriette Henry "
    "Hermine Hervé Hicham Hilaire Hippolyte Honorine Honoré Hortense Hubert Hugues Huguette Hussein Héloïse Héléna Ibrahim Ibrahima Ida Idriss Igor Ilan Iliana Ilyes Imane "
    "Imène Ingrid Irma Irène Isaac Ismaël Issa Ivan Jacky Jacqueline Jamal Jamila Janine Jannick Jason Jawad Jeanine Jeannette Jeannine Jennifer Jessica Jimmy Joachim Joanna "
    "Joaquim Jocelyn Jocelyne Johan Johann Johanna John Jonas Jonathan Jordan Jorge Josette Josiane Josselin Josué José Josée Josépha Joséphine Joyce Joël Joëlle Juan Judith "
    "Jules Julia Julian Juliana Julienne Juliette Justin Justine Jérémie Jérémy Kader Kamel Karima Karine Karl Katia Katy Kelly Kenza Khadija Khaled Khalid Kilian Killian Kim "
    "Kévin Laetitia Lahcen Lamine Lana Lara Larbi Laure Laurence Laurette Laurie Laurine Laurène Laëtitia Leila Leslie Leïla Liam Lidia Lilian Liliane Lilou Lily Lina Linda "
    "Lionel Lisa Lise Lisette Lola Lorenzo Loris Louane Louisa Louison Loïc Loïs Luc Luca Lucette Lucienne Lucile Lucille Ludivine Ludovic Luigi Luis Lydia Lydie Lylia Lyna "
    "Lætitia Léana Léna Léon Léonard Léonce Léonie Léopold Madeleine Mady Maeva Magali Magalie Magdalena Mahdi Malik Malika Mamadou Manuel Manuela Marceau Marcel Marcelin "
    "Marceline Marcelle Marco Margot Marguerite Maria Mariam Marianne Marielle Mariette Marilyne Marina Mario Marion Marius Marjorie Marlène Marthe Martial Martine Maryline "
    "Maryse Maryvonne Mateo Mathias Mathieu Mathis Mathurin Mathéo Matteo Matthias Matthieu Maud Maude Maurice Maurine Maxence Maxime Maximilien Maya Maé Maël Maëlys Maëva "
    "Maïssa Mercedes Michaël Micheline Michèle Mickaël Miguel Mike Mila Milena Milo Mina Mireille Miriam Mohammed Mona Morgan Morgane Mouhamed Mounir Moussa Moïse Muriel "
    "Murielle Mustapha Mylène Myriam Mélanie Mélina Méline Mélissa Mélodie Mériem Nabil Nadine Nadir Nadège Nassim Natacha Natasha Nathan Nathanaël Nawel Naïm Naïma Nelly "
    "Nicole Nicolle Nina Nino Ninon Noa Noah Noham Nolan Nolwenn Nora Norbert Nordine Nour Noé Noël Noëlle Océane Odette Olga Olivia Omar Ophélie Orane Oriane Oscar Othman "
    "Ousmane Pablo Paola Pascale Pascaline Patrice Patricia Paula Paule Paulette Pauline Pedro Perrine Peter Philibert Philippine Philomène Pierrette Pierrick Pietro Priscilla "
    "Rachel Rachid Rachida Rafael Raoul Raphaëlle Rayan Raymond Raymonde Renaud Renée Ricardo Richard Rita Roberte Roberto Rodolphe Roger Roland Rolande Romane Romaric Romuald "
    "Roméo Ronan Rosalie Rose-Marie Roseline Roselyne Rosine Roxane Ruben Ryan Rébecca Régine Régis Réjane Rémy Sabine Sabrina Sacha Safia Salah Salim Salima Salomon Samantha "
    "Sami Samia Samir Samson Samuel Samy Sandra Sandy Sara Saskia Saïd Selim Selma Sharon Sheila Sibylle Sidonie Sigrid Silvia Simona Simone Siméon Sixtine Slimane Sofia "
    "Sofiane Solal Solange Soline Sonia Sophia Soraya Souad Soumaya Stanislas Stella Stephen Steven Stéphanie Suzanne Suzette Suzie Sylvain Sylvaine Sylvestre Sylvette "
    "Sylviane Ségolène Séraphin Séraphine Séverin Séverine Tanguy Tania Tarek Tatiana Teddy Teresa Tessa Thaïs Thibaud Thibault Thibaut Thiphaine Théa Théodore Théophile "
    "Thérèse Tiago Tifany Timothée Timéo Tiphaine Titouan Tom Tony Tristan Ugo Ulysse Ursule Valentin Valentine Valère Valéria Valérian Valéry Vanessa Vianney Vicente Victoria "
    "Victorien Victorine Virgile Vivian Viviane Vladimir Véra Walid Walter Wanda Wassim Wilfrid William Willy Yacine Yannick Yannis Yasmina Yasmine Yassine Yaël Yohan Yohann "
    "Yolande Youcef Youssef Yvan Yvette Yvon Yvonne Zacharie Zakaria Zineb Zohra Zoubida Ève Édith Élena Éliane Élias Élie Élisa Élisabeth Éloïse Éléa Éléonore Émeline Émile "
    "Émilie Émilien Éva Évelyne"
).split()

U, L = "A-ZÀ-ÖØ-ÞŒ", "a-zß-öø-ÿœ"
CAP = rf"[{U}][{L}]+(?:['’-][{U}][{L}]+)*"
ALL = rf"[{U}]{{2,}}(?:['’-][{U}]{{2,}})*"
WORD = rf"(?:{CAP}|{ALL})"
S = r"[^\S\n]+|[^\S\n]*\n[^\S\n]*"  # white space with at most one line feed

# Patterns begin with a set of characters and look behind it, so that the scan skips to candidates.
_MARK = re.compile(r"@\s*|[\[({<]\s*(?:a|at|arobase|arobas|chez)\s*[\])}>]\s*|a(?:robase|robas|t(?=\s+\S+\s+dot\s))(?=\s)\s+", re.I)
# Patterns with REV are matched on the text read backwards, so that what stands before a place has no bound.
_LOCAL_REV = re.compile(r"\s*(?:[\w+%-]+\s*[\])]\s*(?:tniop|tod)\s*[\[(]\s*)*[\w.+%-]+")
_DOMAIN = re.compile(r"[\w-]+(?:(?:\.|\s*[\[({<]\s*(?:point|dot)\s*[\])}>]\s*|\s+(?:point|dot)\s+)[\w-]+)+", re.I)
_DIGIT = re.compile(r"[\d+(](?<![\w+.,/-].)")  # where a phone number may begin
_PHONE = re.compile(
    r"(?<![\w+.,/-])(?:(?:\+|00)\s?33[\s.\-/]*(?:\(0\)[\s.\-/]*)?[1-9](?:[\s.\-/]*\d\d){4}|0[1-9](?:([\s.\-/]*)\d\d)(?:\1\d\d){3}"
    r"|\+(?!33)\d{1,3}[\s.-]?(?:\(\d{1,4}\)[\s.-]?)?\d{2,4}(?:[\s.-]?\d{2,4}){2,4}|\(\d{3}\)\s?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|[2-9]\d\d\.[2-9]\d\d\.\d{4})(?![\d]|[.,/-]\d)"
)
_NIR = re.compile(r"([12])(?<![\w+.,/-].)\s?(\d\d)\s?(\d\d)\s?(\d\d|2[AB])\s?(\d{3})\s?(\d{3})\s?(\d\d)(?!\w)")
_CARD = re.compile(
    r"(?:(?:carte|pièce|papiers?)\s+(?:nationale\s+)?d[’']identité|\bCNI|\bCNIS|identity\s+(?:card|number)|\bID\s+(?:card|number))[\s:.]*(?:(?:n°|no|nº|number|numéro|num\.)[\s:.]*)?((?=[A-Z0-9]*\d)[A-Z0-9]{9}|\d{12})(?!\w)", re.I
)
_PASSPORT = re.compile(r"[A-Z](?<=(?<!\w)\d\d[A-Z])[A-Z]\d{5}(?!\w)")
_TYPES = "|".join(sorted(map(re.escape, STREETS), key=len, reverse=True))
_HOUSE = re.compile(rf"\d(?<![\w.,/-]\d)\d{{0,3}}(?:(?:{S})?(?:[Bb]is|[Tt]er|[Qq]uater|BIS|TER|[A-Ha-h])(?![\w’']))?,?(?:{S})([A-Za-zéÉ-]+\.?)")
_ENGLISH = re.compile(rf"\d(?<![\w.,/-]\d)\d{{0,4}}[A-Za-z]?(?:{S})(?:[{U}][{L}]+(?:['’]s)?(?:{S}))+?(?:{'|'.join(ENGLISH_STREETS)})(?!\w)")
_TYPE = {t.lower() for t in STREETS} | {t.rstrip(".").lower() for t in STREETS}
_TAIL = re.compile(rf"(?:(?:{S})?[,–-]?(?:{S}))(\d{{5}})(?:{S})({CAP}(?:-(?:sur|sous|en|lès|le|la|les|de|du|des|d['’]|{CAP})+)*(?:-{CAP})*)")
_STEP = re.compile(rf"(?:{S})(?:((?:d[eu]s?|la|les?|aux?|à|et|sur|en)(?=\s)|[ldLD]['’](?=[{U}]))|({CAP}|{ALL}|\d{{1,2}}(?=\s+[a-zà-ÿ]{{3,9}}\s+\d{{4}})))")
_LOWER = re.compile(rf"(?:{S})(?:(de(?:{S})la(?:{S})|de(?:{S})l['’]|du(?:{S})|des(?:{S}))|de(?:{S})|d['’])[{L}]{{3,}}(?:['’-][{L}]+)*(?![{U}\w])")
_LOWER_MORE = re.compile(rf"(?:{S})[{L}]+(?:['’-][{L}]+)*(?![{U}\w])")
_ELISION = re.compile(rf"({CAP}|{ALL})")
# What besides a street is called by a person's name.
NAMED = "école collège lycée stade salle parc gymnase fondation société hôtel théâtre square groupe\u00a0scolaire".split(" ")
_NAMED_REV = "|".join(sorted((re.escape(t[::-1]).replace("\u00a0", r"\s+") for t in [*STREETS, *NAMED]), key=len, reverse=True))
_STREET_REV = re.compile(rf"\s*(?:(?:(?:ed|ud|sed|al|el)\s+|['’]d\s*))*(?:{_NAMED_REV})(?!\w)", re.I)
_DETERMINER_REV = re.compile(r"(?:\s+(?:ud|sed|el|al|sel|ua|xua|eht)(?!\w)|['’]l(?!\w))", re.I)
_TITLE = re.compile(rf"[MD](?<!\w[MD])(?:{'|'.join(re.escape(t[1:]) for t in sorted(TITLES, key=len, reverse=True))})(?!\w)(?:{S})")
_GIVEN = {x for g in GIVEN + MORE_GIVEN for x in (g.lower(), "".join(c for c in unicodedata.normalize("NFD", g.lower()) if not unicodedata.combining(c)))}
_INITIAL = re.compile(rf"[{U}](?<![\w.][{U}])\.(?:{S})(?:de\s)?({WORD})")
_SURNAME_INITIAL = re.compile(rf"({WORD})[^\S\n]+[{U}]\.(?!\w)")
_CAPITAL = re.compile(rf"[{U}][\w-]+")
_PAIR = re.compile(rf"(?<![\w.’'@-])({WORD})[^\S\n]+((?:de[^\S\n]+|d['’])?)({WORD})(?![\w@]|['’-]\w)")
# A word of the running text: nothing inside an e-mail address, a link or a code.
_ANY_WORD = re.compile(r"(?<![\w.@+/-])[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\w@+/-]|\.\w)")
_TOKEN = re.compile(rf"(?<![\w.’'@-])({WORD})(?![\w@])")
_NEXT = re.compile(rf"(?:{S})((?:de(?:{S})|d['’])?)({WORD})(?![\w@])")
_TITLED_INITIAL = re.compile(rf"[{U}]\.(?:{S})((?:de(?:{S})|d['’])?){WORD}")
_TITLED = re.compile(rf"((?:de(?:{S})|d['’])?)({WORD})(?![\w@])")
_WHOLE = re.compile(WORD)
_OPEN = {w.lower() for w in OPENERS}
_SAINT = {"saint", "sainte", "st", "ste"}  # begin the names of places


@dataclass(frozen=True)
class Lexicon:
    """What a collection shows about words in small letters: given names, surnames, and words that are no names;
    and pairs of words, joined by a space, that stand after an article."""

    given: frozenset[str] = frozenset()
    surnames: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()
    places: frozenset[str] = frozenset()


def _nir_ok(g: tuple[str, ...]) -> bool:
    body = "".join(g[:6]).replace("2A", "19").replace("2B", "18")
    return 97 - int(body) % 97 == int(g[6])


def _opener(word: str) -> bool:
    return word.lower() in _OPEN or word.split("'")[0].split("’")[0].lower() in ("l", "d", "j", "qu", "n", "s") and "'" in word.replace("’", "'")


def _given(word: str, lex: Lexicon) -> bool:
    """A given name of the collection or the list, with or without its accents, or a compound of them."""
    w = word.lower()
    return w in lex.given or w in _GIVEN or "-" in w and all(part in _GIVEN or part in lex.given for part in w.split("-"))


def _street_end(text: str, at: int) -> int:
    """End of the street name whose type ends at `at`; `at` if no name follows."""
    end, pos, seen = at, at, 0
    while m := _STEP.match(text, pos):
        if m.group(1):
            if seen and m.group(1)[0].isupper():  # opens a sentence or line
                break
            pos = m.end()
            if m.group(1)[-1] in "'’" and (w := _ELISION.match(text, pos)):
                pos = end = w.end()
                seen += 1
            continue
        word = m.group(2)
        if _opener(word) or seen and "\n" in text[end : m.start(2)] or (word.isupper() and seen):
            break
        nxt = text[m.end() : m.end() + 1]
        if seen and (nxt == ":" or text[m.end() : m.end() + 2] == " :"):
            break
        pos = end = m.end()
        seen += 1
    return end


def _lower_end(text: str, at: int) -> int:
    """End of a street name in small letters after `at`, `at` if there is none. After a bare "de" (place de
    stationnement) and for more than one word, postal code and town must follow."""
    if not (m := _LOWER.match(text, at)):
        return at
    end = m.end()
    for _ in range(5):
        if _TAIL.match(text, end):
            return end
        if not (more := _LOWER_MORE.match(text, end)):
            break
        end = more.end()
    return m.end() if m.group(1) else at


def emails(text: str) -> Iterator[tuple[int, int]]:
    if "@" not in text and not any(x in text for x in (")", "]", "}", ">", "arobas", "AROBAS", " dot ")):
        return
    rev = None
    for m in _MARK.finditer(text):
        if (d := _DOMAIN.match(text, m.end())) and re.search(r"[A-Za-z]{2,}\Z", d.group(0)):
            rev = text[::-1] if rev is None else rev
            if a := _LOCAL_REV.match(rev, len(text) - m.start()):
                yield len(text) - a.end(), d.end()


def phones(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for c in _DIGIT.finditer(text):
        if c.start() >= end and (m := _PHONE.match(text, c.start())):
            end = m.end()
            yield m.span()


def identities(text: str) -> Iterator[tuple[int, int]]:
    yield from (m.span() for m in _NIR.finditer(text) if _nir_ok(m.groups()))
    if any(x in text for x in ("dentité", "dentity", "DENTIT", "CNI", "ID ", "Id ")):
        yield from (m.span(1) for m in _CARD.finditer(text))
    yield from ((m.start() - 2, m.end()) for m in _PASSPORT.finditer(text))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _HOUSE.finditer(text):
        if (kind := m.group(1).lower()) not in _TYPE and kind.rstrip(".") not in _TYPE:
            continue
        end = _street_end(text, m.end())
        if end == m.end() and (end := _lower_end(text, m.end())) == m.end():
            continue
        tail = _TAIL.match(text, end)
        yield m.start(), tail.end() if tail else end
    if any(x in text for x in ENGLISH_STREETS):
        for m in _ENGLISH.finditer(text):
            tail = _TAIL.match(text, m.end())
            yield m.start(), tail.end() if tail else m.end()


class _Reader:
    """A text with what its lexicon knows; the text backwards is made when first asked for."""

    def __init__(self, text: str, lex: Lexicon):
        self.text, self.lex, self._rev = text, lex, None

    def before(self, pattern: re.Pattern, at: int) -> bool:
        if self._rev is None:
            self._rev = self.text[::-1]
        return bool(pattern.match(self._rev, len(self.text) - at))

    def given(self, word: str) -> bool:
        return _given(word, self.lex)

    def no_name(self, word: str) -> bool:
        return _opener(word) or word.lower() in self.lex.common

    def word_before(self, at: int) -> tuple[int, str, str] | None:
        """(start, word, space): the capitalised word before a place, with at most one line feed between."""
        end = at
        while end and self.text[end - 1].isspace():
            end -= 1
        space = self.text[end:at]
        start = end
        while start and (self.text[start - 1].isalpha() or self.text[start - 1] in "'’-"):
            start -= 1
        if not space or space.count("\n") > 1 or start and (self.text[start - 1].isalnum() or self.text[start - 1] in "._@"):
            return None
        return (start, self.text[start:end], space) if _WHOLE.fullmatch(self.text, start, end) else None


def names(text: str, lex: Lexicon = Lexicon()) -> Iterator[tuple[int, int]]:
    """Names after a title; initial and surname; given name and surname in either order; and two words side by
    side that are names by the lexicon's word, or that nothing speaks against."""
    t, spans = _Reader(text, lex), []
    for m in _TITLE.finditer(text):
        if span := _after_title(t, m.end()):
            spans.append(span)
    for m in _INITIAL.finditer(text):
        if text[m.start()] != "M" and not _opener(m.group(1)):
            spans.append(m.span())
    for c in _CAPITAL.finditer(text):
        word = c.group(0).lower()
        if word in _OPEN or word in lex.common and word not in _GIVEN:
            continue
        if t.given(word):
            if m := _TOKEN.match(text, c.start()):
                spans.extend(_around_given(t, m))
        elif m := _PAIR.match(text, c.start()):
            spans.extend(_side_by_side(t, m))
        elif word in lex.surnames and (m := _SURNAME_INITIAL.match(text, c.start())):
            spans.append(m.span())
    taken = -1
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= taken:
            taken = b
            yield a, b


def _next_word(text: str, at: int) -> re.Match | None:
    return _NEXT.match(text, at)


def _after_title(t: _Reader, at: int) -> tuple[int, int] | None:
    """The name after a title: a surname alone, or all words of a fuller name, never half of one."""
    text = t.text
    if m := _TITLED_INITIAL.match(text, at):
        return m.span()
    m = _TITLED.match(text, at)
    if not m or _opener(m.group(2)):
        return None
    end, word, known = m.end(), m.group(2), m.group(2).lower() in t.lex.surnames
    while nxt := _next_word(text, end):
        if "\n" in text[end : nxt.end()] or _opener(nxt.group(2)) or text[nxt.end() : nxt.end() + 1] == "'":
            break
        given = t.given(word) or t.given(nxt.group(2)) and not nxt.group(1)
        # Beside a surname that stands alone elsewhere, the next word must itself be a given name.
        if not given and (known or t.no_name(nxt.group(2))):
            break
        more, end, word = t.given(word) and t.given(nxt.group(2)), nxt.end(), nxt.group(2)
        if not more:
            break
    return m.start(), end


def _around_given(t: _Reader, m: re.Match) -> Iterator[tuple[int, int]]:
    text = t.text
    if t.before(_STREET_REV, m.start()):
        return
    nxt, before = _next_word(text, m.end()), t.word_before(m.start())
    # A given name may be the surname of one before it; then the next line does not belong to it.
    ends = before and t.given(before[1]) and "\n" not in before[2] and nxt and "\n" in text[m.end() : nxt.end()]
    last = nxt
    while last and t.given(last.group(2)) and "\n" not in text[m.end() : last.end()]:  # several given names
        last = _next_word(text, last.end())
        if last and ("\n" in text[m.end() : last.end()] or t.no_name(last.group(2))):
            last = None
    if last and not ends and not _opener(last.group(2)) and not t.given(last.group(2)):
        yield m.start(), last.end()
        return
    if before and before[1].lower() not in _SAINT and not _opener(before[1]) and not re.match(r"\s*['’-]", text[m.end() : m.end() + 1]):
        if not t.before(_STREET_REV, before[0]):
            yield before[0], m.end()


def _side_by_side(t: _Reader, m: re.Match) -> Iterator[tuple[int, int]]:
    """Two capitalised words of which none is a given name so far known. One that is known as a surname makes the
    other its given name. Two unknown ones are a name if they are just two, not both in capitals, and no
    article, street or the like stands before them."""
    a, b = m.group(1), m.group(3)
    if t.no_name(a) or t.no_name(b) or a.lower() in _SAINT or t.given(b):
        return
    if t.before(_STREET_REV, m.start()) or f"{a} {b}".lower() in t.lex.places:
        return
    if a.lower() in t.lex.surnames or b.lower() in t.lex.surnames:
        yield m.span()
        return
    alone = not (w := t.word_before(m.start())) or t.no_name(w[1]) or "\n" in w[2]
    after = _PAIR.match(t.text, m.start(3))
    if alone and not m.group(2) and not (after and not t.no_name(after.group(3))) and not (a.isupper() and b.isupper()) and not t.before(_DETERMINER_REV, m.start()):
        yield m.span()


# Words before a birth date, and the names of months.
_BORN = r"(?:\b[Nn]ée?s?\s+le|\b[Dd]ate\s+de\s+naissance|\b[Bb]orn(?:\s+on)?|\b[Dd]ate\s+of\s+birth)[\s:]*(?:le\s+|the\s+)?"
MONTHS = (
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "January February March April May June July August September October November December".split(),
)
_BIRTH = re.compile(rf"{_BORN}(\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}(?:er)?\s+(?:{'|'.join(MONTHS[0] + MONTHS[1])})\s+\d{{4}})(?!\d)")


def births(text: str) -> Iterator[tuple[int, int]]:
    if any(x in text for x in ("née", "né ", "nés", "Né", "naissance", "orn ", "birth")):
        yield from (m.span(1) for m in _BIRTH.finditer(text) if _day(m.group(1)))


#: Earlier kinds win where two details overlap.
KINDS = (("email", emails), ("id_number", identities), ("phone", phones), ("address", addresses), ("birth_date", births))


def details(text: str | None, lex: Lexicon | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every detail in text order, without overlaps. lex: what the collection shows about
    words; without it, what the text itself shows."""
    text = text or ""
    lex = _lexicon_of(text) if lex is None else lex
    starts: list[int] = []
    found: dict[int, tuple[str, int, int]] = {}

    def take(kind: str, a: int, b: int) -> None:
        i = bisect_left(starts, a)
        if (i == len(starts) or starts[i] >= b) and (not i or found[starts[i - 1]][2] <= a):
            insort(starts, a)
            found[a] = (kind, a, b)

    for kind, find in KINDS:
        for a, b in find(text):
            take(kind, a, b)
    for a, b in names(text, lex):
        take("name", a, b)
    return [found[a] for a in starts]


# --- evidence of the collection ------------------------------------------------------------------------

def _evidence(texts: Iterable[str | None]) -> Iterator[tuple[str, str, str, int]]:
    """Partial (kind, a, b, n): c, l: a word with and without a capital; s: a name alone after a title or an
    initial; p: two capitalised words side by side; d: the same after an article."""
    raw: Counter = Counter()
    seen: Counter = Counter()

    def flush():
        words: Counter = Counter()
        for token, n in raw.items():  # what a word is, is asked once for each different piece between spaces
            for w in _ANY_WORD.findall(token):
                words["l" if w[0].islower() else "c", w.lower(), ""] += n
        yield from ((*k, n) for k, n in words.items())
        yield from ((*k, n) for k, n in seen.items())
        raw.clear(), seen.clear()

    for text in texts:
        if not text:
            continue
        t = _Reader(text, Lexicon())
        raw.update(text.split())
        for m in _TITLE.finditer(text):
            if (w := _TITLED.match(text, m.end())) and not _opener(w.group(2)):
                nxt = _next_word(text, w.end())
                if not nxt or "\n" in text[w.end() : nxt.end()] or _opener(nxt.group(2)):
                    seen["s", w.group(2).lower(), ""] += 1
        for m in _INITIAL.finditer(text):
            if text[m.start()] != "M" and not _opener(m.group(1)):
                seen["s", m.group(1).lower(), ""] += 1
        for c in _CAPITAL.finditer(text):
            if c.group(0).lower() in _OPEN or not (m := _PAIR.match(text, c.start())):
                continue
            if not _opener(m.group(1)) and not _opener(m.group(3)) and not t.before(_STREET_REV, m.start()):
                kind = "d" if t.before(_DETERMINER_REV, m.start()) else "p"
                seen[kind, m.group(1).lower(), m.group(3).lower()] += 1
        if len(raw) + len(seen) > FLUSH:
            yield from flush()
    yield from flush()


def evidence(rows: DataFrame, text: str) -> DataFrame:
    """(kind, a, b, n) over all texts, as `_evidence` says, combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*part)) if part else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["kind", "a", "b", "n"])

        block: list[tuple] = []
        for row in _evidence(t for b in batches for t in b.column(0).to_pylist()):
            block.append(row)
            if len(block) >= 50_000:
                yield out(block)
                block = []
        yield out(block)

    partial = rows.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "kind string, a string, b string, n long")
    return partial.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


#: A word is none of a name if more than this share of it is written in small letters.
SMALL_SHARE = 0.15
#: A given name stands beside so many different surnames, and alone after titles at most in this share of its places.
PARTNERS, ALONE_SHARE = 2, 0.1


def lexicon(seen: DataFrame) -> DataFrame:
    """(word, kind): given, surname, common and place, by the rules of SMALL_SHARE, PARTNERS and ALONE_SHARE, from the
    evidence; only words that stand in a pair or alone after a title or an initial, and pairs of such words."""
    seen = written(seen, "evidence")
    pairs = seen.where("kind IN ('p', 'd')")
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other")))).alias("x"), "n", "kind").select("x.*", "n", "kind")
    single = seen.where("kind = 's'").select(F.col("a").alias("word"), F.col("n").alias("alone"))
    named = sides.select("word").union(single.select("word")).distinct()
    letters = seen.where("kind IN ('c', 'l')").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("kind") == "l", F.col("n")).otherwise(0)).alias("small"))
    common = letters.join(named, "word", "left_semi").where(F.col("small") > SMALL_SHARE * F.col("all")).select("word")
    surname = single.join(common, "word", "left_anti")
    beside = sides.where("kind = 'p'").join(surname.select(F.col("word").alias("other")), "other", "left_semi").groupBy("word").agg(F.count_distinct("other").alias("partners"))
    total = sides.where("kind = 'p'").groupBy("word").agg(F.sum("n").alias("paired"))
    given = (
        beside.where(F.col("partners") >= PARTNERS).join(total, "word").join(single, "word", "left").na.fill(0, ["alone"])
        .where(F.col("alone") <= ALONE_SHARE * (F.col("alone") + F.col("paired"))).join(common, "word", "left_anti").select("word")
    )
    # A given name may by chance have stood alone once; it is no surname then.
    surname = surname.join(given, "word", "left_anti").select("word")
    place = pairs.where("kind = 'd'").select(F.concat_ws(" ", "a", "b").alias("word"))
    parts = {"given": given, "surname": surname, "common": common, "place": place}
    out = None
    for kind, df in parts.items():
        df = df.select("word", F.lit(kind).alias("kind"))
        out = df if out is None else out.unionByName(df)
    return written(out, "lexicon")


def _lexicon_of(text: str) -> Lexicon:
    """The lexicon of a single text, by the same rules as far as one text can show them."""
    counts: Counter = Counter()
    for kind, a, b, n in _evidence([text]):
        counts[kind, a, b] += n
    words = {w for k, a, b in counts if k in "pds" for w in (a, b) if w}
    common = {w for w in words if counts["l", w, ""] > SMALL_SHARE * (counts["l", w, ""] + counts["c", w, ""])}
    surnames = {a for k, a, _ in counts if k == "s"} - common
    return Lexicon(frozenset(), frozenset(surnames), frozenset(common), frozenset(f"{a} {b}" for k, a, b in counts if k == "d"))


def _as_lexicon(rows: Iterable[tuple[str, str]]) -> Lexicon:
    kinds: dict[str, set[str]] = {"given": set(), "surname": set(), "common": set(), "place": set()}
    for word, kind in rows:
        kinds[kind].add(word)
    return Lexicon(*(frozenset(kinds[k]) for k in ("given", "surname", "common", "place")))


def known(rows: DataFrame, record: str, text: str, most_words: int | None = None) -> tuple[DataFrame, Lexicon | None]:
    """(rows of record and text, lexicon) with what all texts show about words. A lexicon beyond `most_words` stays a
    table: then it is None, and each row has its own share as `__lex`, joined by the words of the row."""
    words = lexicon(evidence(rows, text))
    rows = rows.select(record, text)
    if words.count() <= (MOST_WORDS if most_words is None else most_words):
        return rows, _as_lexicon((r["word"], r["kind"]) for r in words.collect())
    kind = rows.schema[record].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, mine = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = {w.lower() for w in _CAPITAL.findall(t or "")} | {w.lower() for w in _ANY_WORD.findall(t or "") if w[0].isupper()}
                for m in filter(None, (_PAIR.match(t, c.start()) for c in _CAPITAL.finditer(t or ""))):
                    found |= {m.group(1).lower(), m.group(3).lower(), f"{m.group(1)} {m.group(3)}".lower()}
                ids += [i] * len(found)
                mine += found
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(mine, pa.string())], ["__id", "word"])

    of_rows = rows.where(F.col(text).isNotNull()).mapInArrow(run, f"__id {kind}, word string").distinct().join(words, "word")
    share = of_rows.groupBy("__id").agg(F.collect_list(F.struct("word", "kind")).alias("__lex"))
    return rows.join(share, F.col(record).eqNullSafe(F.col("__id")), "left").drop("__id"), None


def as_value(text: str) -> str:
    """The detail with every run of white space as one space, without a final full stop or comma."""
    return re.sub(r"\s+", " ", text).strip().rstrip(".,").rstrip()


def _round(key: bytes, label: str, i: int, half: str) -> int:
    return int.from_bytes(hmac.digest(key, f"{label}|{i}|{half}".encode(), "sha256")[:16], "big")


def feistel(key: bytes, label: str, digits: str, rounds: int = 10) -> str:
    """Keyed permutation of the strings of len(digits) decimal digits (alternating Feistel network)."""
    n = len(digits)
    if n < 2:
        return str(within(key, label, int(digits), 10)) if n else ""
    u = n // 2
    a, b = digits[:u], digits[u:]
    for i in range(rounds):
        c = (int(a) + _round(key, label, i, b)) % 10 ** len(a)
        a, b = b, str(c).zfill(len(a))
    return a + b


def within(key: bytes, label: str, value: int, size: int) -> int:
    """Keyed permutation of 0..size-1: the network on as many digits, walked until it is back inside."""
    width = max(2, len(str(size - 1)))
    while True:
        value = int(feistel(key, label, f"{value:0{width}d}"))
        if value < size:
            return value


def _refill(shape: str, chars: str) -> str:
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


_FIRST, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def _day(value: str) -> datetime.date | None:
    """A written date between 1900 and 2099."""
    words = re.findall(r"\d+|[^\W\d_]+", re.sub(r"(?<=\d)er\b", "", value))
    try:
        a, b, c = (int(w) if w.isdigit() else next(m.index(w) + 1 for m in MONTHS if w in m) for w in words)
        found = datetime.date(a, b, c) if a > 31 else datetime.date(c, b, a)
    except (ValueError, StopIteration):
        return None
    return found if 1900 <= found.year <= 2099 else None


def _redated(key: bytes, value: str) -> str:
    """Another date of the years 1900 to 2099, written the same way."""
    new = _FIRST + datetime.timedelta(days=within(key, "day", (_day(value) - _FIRST).days, _DAYS))
    if m := re.fullmatch(r"(\d+)(?:er)?(\s+)(\w+)(\s+)(\d+)", value):
        names_ = next(n for n in MONTHS if m.group(3) in n)
        first = "er" if new.day == 1 and names_ is MONTHS[0] else ""
        return f"{new.day}{first}{m.group(2)}{names_[new.month - 1]}{m.group(4)}{new.year}"
    parts = re.split(r"([./-])", value)
    digits = (new.year, new.month, new.day) if len(parts[0]) == 4 else (new.day, new.month, new.year)
    return "".join(x if i % 2 else f"{digits[i // 2]:0{len(x)}d}" for i, x in enumerate(parts))


def pseudonym(key: bytes, kind: str, value: str) -> str:
    """A value of the same format for numbers and dates; a keyed code of 64 bits for the other kinds."""
    bare = "".join(c for c in value if c.isalnum())
    if kind == "birth_date":
        return _redated(key, value)
    if kind == "phone":
        french = bare.startswith(("33", "0033")) or len(bare) == 10 and bare[0] == "0"
        keep = (len(bare) - 8) if french else max(len(bare) - 7, 0)
        # The national number is permuted without its way of writing, so 06.., +336.. stay linked.
        return _refill(value, bare[:keep] + feistel(key, "phone", bare[keep:]))
    if kind == "id_number" and (m := _NIR.fullmatch(value)):
        g = m.groups()
        year = f"{within(key, 'year', int(g[1]), 100):02d}"
        month = f"{within(key, 'month', int(g[2]) - 1, 12) + 1:02d}" if 1 <= int(g[2]) <= 12 else g[2]
        serial = feistel(key, "nir", g[4] + g[5])
        body = g[0] + year + month + g[3] + serial
        check = 97 - int(body.replace("2A", "19").replace("2B", "18")) % 97
        return _refill(value, f"{body}{check:02d}")
    if kind == "id_number":
        digits = iter(feistel(key, "id", "".join(c for c in bare if c.isdigit())))
        letters = [ord(c.upper()) - 65 for c in bare if c.isascii() and c.isalpha()]
        n = 0
        for x in letters:
            n = n * 26 + x
        n, spelt = within(key, "letters", n, 26 ** len(letters)) if letters else 0, []
        for _ in letters:
            n, x = divmod(n, 26)
            spelt.append(chr(65 + x))
        return "".join(next(digits) if c.isdigit() else spelt.pop() if c.isascii() and c.isalpha() else c for c in value)
    return hmac.new(key, f"{kind}|{bare.lower()}".encode(), hashlib.sha256).hexdigest()[:16]


def replaced(text: str | None, key: bytes, lex: Lexicon | None = None) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in details(text, lex):
        value = as_value(text[a:b])
        trail = len(text[a:b]) - len(text[a:b].rstrip(" .,\n"))
        out += [text[at:a], f"[{kind.upper()} {pseudonym(key, kind, value)}]"]
        at = b - trail
    return "".join(out) + text[at:]


def find(rows: DataFrame, record: str = "doc_id", text: str = "text", most_words: int | None = None) -> DataFrame:
    """(record, kind, value, start_pos): one row per occurrence; null and empty texts give none.

    The texts are read twice: for what they show about words, and for their details.
    """
    rows, lex = known(rows, record, text, most_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, values, starts = [], [], [], []
            own = [None] * len(batch) if lex is not None else batch.column(2).to_pylist()
            for i, t, mine in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), own):
                for kind, a, b in details(t, lex if lex is not None else _as_lexicon((x["word"], x["kind"]) for x in mine or ())):
                    ids.append(i), kinds.append(kind), values.append(as_value(t[a:b])), starts.append(a)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(starts, pa.int32())], ["id", "kind", "value", "start_pos"])

    kind = rows.schema[record].dataType.simpleString()
    return rows.where(F.col(text).isNotNull()).mapInArrow(run, f"id {kind}, kind string, value string, start_pos int").withColumnRenamed("id", record)


def replace(rows: DataFrame, key: str, record: str = "doc_id", text: str = "text", most_words: int | None = None) -> DataFrame:
    """(record, text) with every detail replaced by `[KIND pseudonym]`; null texts stay null.

    key is a secret of the caller: with the same key, equal values get equal pseudonyms everywhere.
    """
    if not key:
        raise ValueError("a key is needed")
    secret = key.encode()
    rows, lex = known(rows, record, text, most_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [None] * len(batch) if lex is not None else batch.column(2).to_pylist()
            new = [replaced(t, secret, lex if lex is not None else _as_lexicon((x["word"], x["kind"]) for x in mine or ())) for t, mine in zip(batch.column(1).to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], [record, text])

    kind = rows.schema[record].dataType.simpleString()
    return rows.mapInArrow(run, f"{record} {kind}, {text} string")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every personal detail of the five kinds of every document, once per document."""
    found = find(spark.read.parquet(f"{sf}/documents.parquet")).where("kind <> 'birth_date'")
    return found.select("doc_id", "kind", "value").distinct()


def p10_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with their personal details replaced, under the key of LUTRIN_PSEUDONYM_KEY."""
    key = os.environ.get("LUTRIN_PSEUDONYM_KEY")
    if not key:
        logger.warning("LUTRIN_PSEUDONYM_KEY is not set: a key is drawn, pseudonyms of this run match no other's")
        key = secrets.token_hex(32)
    return replace(spark.read.parquet(f"{sf}/documents.parquet"), key)


QUERIES = {"p10_found": p10_found, "p10_replaced": p10_replaced}
ORACLE: dict[str, str] = {}
