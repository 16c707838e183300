"""Problem 6: broken prompt and response pairs, by a multi-label linear classifier.

Each label has one logistic output over hashed word n-grams of what the answer
says outside of its programs and over features of the pair: how the answer
ends, how much of it repeats the prompt and how much of the prompt it repeats,
the languages of both, programs in it and what the prompt asks for.  The
classifier is trained here, on SAMPLE sound pairs of each source that are
synthetically emptied, cut, refused, copied and swapped; every other weight
than the pair features' and every threshold comes from them.  Synthesis and
features are computed where the rows are; the fit itself sees at most
SAMPLE x sources x VARIANTS rows.  Thresholds are calibrated on the pairs of
held-out keys.  A pair gets the label whose score is highest above its
threshold, so at most one.

Every answer is read whole and looked up in its prompt.

Defined results: null, blank and placeholder answers are empty; a null prompt
asks for nothing, so nothing is copied from it or mismatches its language;
repeated rows count once; rows without key take no part.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestack.llm import grams as G
from lodestack.llm import structure as S
from lodestack.llm.splitleak import task_text
from lodestack.operators.joins import hot_joined

LABELS = ("empty", "truncated", "refusal", "copy", "other_language")
#: Sound pairs of each source to train on, the most rows made of one, hashed dimensions, rounds of the fit; share of rows without n-grams.
SAMPLE, VARIANTS, DIMENSIONS, ROUNDS = 1000, 11, 1 << 15, 150
MUTED = 1 / 4
#: Frequent words by language.
WORDS_OF = {
    "en": "the of is and to that with by after its when only for it was because be are have not before than on a no i you if as my this from at or so but which there will would can all an in",
    "de": "der die das und ist nicht wird für auf eine einer zu mit sich als den dem wurde hat durch ich hier keine am im des werden dieser nie ob so weil nie sind müssen bei aus an um zum zur oder noch dann nur von ein",
    "es": "el la los las que de se en con por para una del como más cuando es fue así según no lo y esta este un sobre hay cada pero sin está están también todavía qué sólo después debe ningún su al",
    "fr": "le la les des est que une dans pour par sur avec plus cette pas du été au ne à je et ce un a qui que sont cette même si après doit être pourquoi on ou mais sans de il en",
    "pt": "o a os as não que de em com para uma da do dos se já mais é são foi nas nos e esta este um há por contém também até após nunca então cada quando sem sobre seu sua pelo pela ao isso qual",
    "ru": "и в не на что с по из к как для за от но при это или если я",
}
_LETTERS = re.compile(r"[^\W\d_]+")
_FREQUENT = {k: frozenset(v.split()) for k, v in WORDS_OF.items()}
_ACCENTS = {"de": "äöüß", "es": "ñ¿¡", "fr": "çèêœàîôùâë", "pt": "ãõç"}
_VERDICT = re.compile(r"(?i)^\W*(?:pass|fail|passed|failed|yes|no|true|false|correct|incorrect|valid|invalid)\b")
_ASKS_VERDICT = re.compile(r"(?i)\b(?:pass or fail|yes or no|true or false|correct or incorrect|valid or invalid)\b")
_ASKS_PROSE = re.compile(r"(?i)^\s*(?:explain|describe|summari[sz]e|why|erkläre|beschreibe|explica|describe|explique|décris|descreva|объясни|опиши)\b")
_CODE_START = re.compile(r"(?m)^(?:```\w*\s*\n)?[ \t]*(?:def |import |from \w+ import|class |[A-Za-z_]\w* = )")
_CODE_LINE = re.compile(r"^\s*(?:def |import |from \w+ import|class |return\b|for .*:|while .*:|if .*:|elif .*:|else:|try:|except\b|with .*:|print\(|@\w|[\w.\[\]'\", ]+ [-+*/%^|&<>]{0,2}= |[\w.]+\(.*\)\s*$|[}\])];?\s*$|.*[{;]\s*$|#include)")
_BRACES = re.compile(r"(?m)[;{}][ \t]*$")
_COMMENT = re.compile(r"(?m)^\s*(?:#+|//|```\w*)[ \t]*")


def language(text: str) -> str | None:
    """The human language of prose, of those in WORDS_OF; None where there is too little to tell."""
    low = text.lower()
    letters = sum(map(len, words := _LETTERS.findall(low)))
    if not letters:
        return None
    if sum("а" <= c <= "я" or c == "ё" for c in low) > 0.4 * letters:
        return "ru"
    score = {k: float(sum(w in s for w in words)) for k, s in _FREQUENT.items() if k != "ru"}
    for k, s in _ACCENTS.items():
        score[k] += 1.5 * sum(low.count(c) for c in s)
    best = max(score, key=lambda k: score[k])
    second = max(v for k, v in score.items() if k != best)
    return best if score[best] >= max(2, 0.08 * len(words)) and score[best] > second else None


def _runs(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:], words[2:]))


def prompt_prose(prompt: str) -> str:
    """What a prompt says in prose, without template lines and programs."""
    task = re.sub(r"(?m)^Public task prompt:\s*$|^Task:\s*$", "", task_text(prompt))
    return _CODE_START.split(task, maxsplit=1)[0]


class Prompt:
    """What the features need of a prompt; computed once for successive rows of one prompt."""

    def __init__(self, text: str | None):
        self.known = bool(text and text.strip())
        text = text or ""
        self.verdict, self.prose = bool(_ASKS_VERDICT.search(text)), bool(_ASKS_PROSE.search(text))
        self.words = G.WORD.findall(text.lower())
        self.vocabulary = set(self.words)
        self.spoken = prompt_prose(text) if self.known else ""
        self.language = language(self.spoken) if self.known else None
        self._runs = None

    def runs(self) -> tuple[set, set]:
        """Runs of three words of the whole prompt and of its task."""
        if self._runs is None:
            self._runs = _runs(self.words), _runs(G.WORD.findall(self.spoken.lower()))
        return self._runs


FEATURES = (
    "bias", "empty", "open", "unterminated", "prose_open", "mark", "known", "asks_verdict", "asks_prose", "asks_code", "python", "other_code", "other_for_code", "no_code_for_code", "prose_for_verdict",
    "foreign", "foreign_prose", "same_language", "copied", "covered", "copied_and_covered", "copy_of_task", "verdict", "length", "short", "shared_words", "names", "braces", "open_code", "findings",
)
_AT = {k: i for i, k in enumerate(FEATURES)}


def said(answer: str, program: bool) -> str:
    """What an answer says outside of its programs, comments included where there is no program."""
    if program:
        return "\n".join(x for x in re.sub(r"(?ms)^[ \t]*```.*?(?:^[ \t]*```[ \t]*$|\Z)", "", answer).split("\n") if not x.startswith((" ", "\t", "#", "//")) and not _CODE_LINE.match(x))
    return _COMMENT.sub("", answer)


def features(prompt: Prompt | str | None, answer: str | None) -> tuple[np.ndarray, str]:
    """The pair features of FEATURES, and what the answer says in prose."""
    p = prompt if isinstance(prompt, Prompt) else Prompt(prompt)
    x = np.zeros(len(FEATURES), dtype=np.float32)

    def put(**values: float) -> None:
        for k, v in values.items():
            x[_AT[k]] = v

    code = p.known and not p.verdict and not p.prose
    put(bias=1, known=p.known, asks_verdict=p.verdict, asks_prose=p.prose, asks_code=code)
    stated = bool(answer and _VERDICT.match(answer))
    if answer is None or not answer.strip() or (S.PLACEHOLDER.match(answer) and not (p.verdict and stated)):
        put(empty=1)
        return x, ""
    findings = "ERROR_FINDINGS:" in answer
    part = answer.split("REVISED_CODE:", 1)[1] if "REVISED_CODE:" in answer else answer
    python = bool(S.PYTHON.search(part))
    other = not python and bool(S.OTHER_CODE.search(answer))
    spoken = answer.split("REVISED_CODE:", 1)[0] if findings else said(answer, python or other)
    # findings that don't get to their program break off
    end = "open" if findings and not (python or other) else S.answer_end(part)[0]
    prose = spoken if not (python or other or findings) else ""
    prose_open = bool(prose.strip()) and end == "complete" and S.prose_end(prose) != "complete"
    if p.verdict and stated and len(answer.split()) < 3:
        prose_open, end = False, "complete"
    if prose and end == "unterminated":
        prose_open = True
    marked = S.cut_mark(answer)
    put(open=end == "open", unterminated=end == "unterminated" and not prose, prose_open=prose_open and not marked, mark=marked, open_code=end == "open" and (python or other))
    put(python=python, other_code=other, other_for_code=other and not p.prose, no_code_for_code=code and not (python or other or findings), findings=findings, verdict=stated, prose_for_verdict=p.verdict and not stated)
    words = G.WORD.findall(answer.lower())
    distinct = set(words)
    shared = len(distinct & p.vocabulary) / len(distinct) if distinct else 0.0
    if shared > 0.3 and len(words) > 4:  # fewer common words leave no long copy
        mine, (whole, task) = _runs(words), p.runs()
        common = len(mine & whole)
        copied = common / len(mine) if mine else 0.0
        covered = common / len(whole) if whole else 0.0
        of_task = len(mine & task) / len(task) if task else 0.0
        most = max(covered, of_task)
        put(copied=copied, covered=most, copied_and_covered=copied * most, copy_of_task=copied > 0.5 and most > 0.5)
    mother = language(spoken) if spoken.strip() else None
    foreign = bool(mother and p.language and mother != p.language)
    put(foreign=foreign, foreign_prose=foreign and bool(prose), same_language=bool(mother) and mother == p.language)
    put(length=min(1.0, math.log1p(len(words)) / 7), short=len(answer) < 220, shared_words=shared, names=min(1.0, sum("_" in w for w in distinct) / 5), braces=len(_BRACES.findall(answer)) / (answer.count("\n") + 1))
    return x, prose or (spoken if findings else "")


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, dimension) of each text's hashed words and word pairs; a text's values are all 1 / sqrt(their number)."""
    ids, counts = G.token_ids([t.lower() for t in texts], G.WORD)
    own1 = np.repeat(np.arange(len(texts)), counts)
    h2, own2, _ = G.grams(ids, counts, 2)
    h, own = np.concatenate([G.mix(ids), h2]), np.concatenate([own1, own2])
    key = np.unique((own.astype(np.uint64) << np.uint64(20)) | (h & np.uint64(DIMENSIONS - 1)))
    return (key >> np.uint64(20)).astype(np.int64), (key & np.uint64(DIMENSIONS - 1)).astype(np.int64)


def _starts(index: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an index, and where each one's rows start, in ``order`` or as they come sorted."""
    sorted_ = index if order is None else index[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(index) else np.zeros(0, dtype=np.int64)
    return sorted_[starts], starts


class Model:
    """One logistic output a label over the pair features and the hashed n-grams."""

    def __init__(self):
        self.dense = np.zeros((len(FEATURES), len(LABELS)), dtype=np.float32)
        self.sparse = np.zeros((DIMENSIONS, len(LABELS)), dtype=np.float32)
        self.thresholds = np.full(len(LABELS), 0.5)

    def scores(self, dense: np.ndarray, row: np.ndarray, dim: np.ndarray) -> np.ndarray:
        z = dense @ self.dense
        if len(row):
            n = np.bincount(row, minlength=len(dense))
            rows, starts = _starts(row)
            z[rows] += np.add.reduceat(self.sparse[dim], starts) / np.sqrt(n[rows])[:, None]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, dense: np.ndarray, row: np.ndarray, dim: np.ndarray, y: np.ndarray, held: np.ndarray) -> "Model":
        """Gradient steps on the rows that aren't held out, thresholds on those that are; ``y`` is the label's number or -1."""
        new = np.cumsum(~held) - 1
        keep = ~held[row]
        d, r, c = dense[~held], new[row[keep]], dim[keep]
        want = (y[~held, None] == np.arange(len(LABELS))).astype(np.float32)
        value = (1 / np.sqrt(np.maximum(np.bincount(r, minlength=len(d)), 1)))[r].astype(np.float32)
        rows, starts = _starts(r)
        order = np.argsort(c, kind="stable")
        dims, dim_starts = _starts(c, order)
        by_row, by_value = r[order], value[order, None]
        step_d, step_s = np.full_like(self.dense, 1e-6), np.full((len(dims), len(LABELS)), 1e-6, dtype=np.float32)
        weight = 1 + want
        for _ in range(ROUNDS):
            z = d @ self.dense
            if len(starts):
                z[rows] += np.add.reduceat(self.sparse[c] * value[:, None], starts)
            slope = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - want) / len(d)
            gd = d.T @ slope + 1e-6 * self.dense
            step_d += gd * gd
            self.dense -= 0.5 * gd / np.sqrt(step_d)
            if len(dims):
                gs = np.add.reduceat(slope[by_row] * by_value, dim_starts) + 1e-6 * self.sparse[dims]
                step_s += gs * gs
                self.sparse[dims] -= 0.2 * gs / np.sqrt(step_s)
        self._calibrate(self.scores(dense, row, dim)[held], y[held])
        return self

    def _calibrate(self, p: np.ndarray, y: np.ndarray) -> None:
        """Thresholds half-way, in log-odds, between the least scores of a label's held-out cases and the highest of all others'."""
        odds = np.log(np.clip(p, 1e-9, 1 - 1e-9) / np.clip(1 - p, 1e-9, 1))
        for k in range(len(LABELS)):
            own, other = np.sort(odds[y == k, k]), np.sort(odds[y == -1, k])
            if len(own) and len(other):
                low, high = own[int(0.005 * len(own))], other[min(len(other) - 1, int(0.9995 * len(other)))]
                self.thresholds[k] = 1 / (1 + math.exp(-float(np.clip((low + high) / 2, -1.5, 1.5))))

    def label(self, prompts: list, answers: list) -> list[str | None]:
        known: dict = {}
        rows = []
        for p, a in zip(prompts, answers):
            if p not in known:
                if len(known) > 64:
                    known.clear()
                known[p] = Prompt(p)
            rows.append(features(known[p], a))
        p = self.scores(np.stack([x for x, _ in rows]), *hashed([t for _, t in rows])) if rows else np.zeros((0, len(LABELS)))
        lead = np.where(p >= self.thresholds, p, -1.0)
        best = lead.argmax(axis=1) if len(p) else []
        return [LABELS[k] if lead[i, k] > 0 else None for i, k in enumerate(best)]


#: A grammar of synthetic refusals: every alternative of a part goes with every alternative of the next; {1} is a word of the prompt.
_REFUSAL = {
    "en": (
        ("I'm sorry, but", "Sorry,", "I apologize, but", "Unfortunately,", "Regrettably,", "I'm afraid", "Thank you for your question, but", "As an AI,", "As a language model,", "No:", ""),
        (
            (("I", "we"), ("cannot", "can't", "could not", "am not able to", "am unable to", "do not", "don't", "won't", "will not", "would rather not", "prefer not to", "must decline to", "have to decline to", "refuse to", "am not allowed to", "may not"), ("help with", "assist with", "write", "answer", "provide", "produce", "solve", "complete", "give", "discuss", "work on", "share", "do"), ("this", "that", "it", "this request", "this task", "this question", "this program", "the code", "a solution", "your assignment", "tasks like this", "a question about {1}", "a program for {1}", "{1}")),
            (("this", "this request", "the question", "this task", "your request"), ("is outside", "is beyond", "goes beyond", "is not within"), ("what I can do", "what I am able to answer", "my abilities", "my scope", "what I am allowed to do")),
            (("no answer", "no solution", "no code"), ("is available", "can be given", "can be provided", "is possible"), ("here", "from me", "for this request", "for {1}")),
            (("please", "you should", "you will have to"), ("solve", "write", "do", "try"), ("this", "{1}", "the exercise"), ("yourself", "by yourself", "without my help")),
            (("my guidelines", "my rules", "the policy", "my instructions"), ("prevent me from", "forbid me from", "stop me from"), ("answering", "helping", "writing this", "giving solutions", "discussing {1}")),
            (("it is not appropriate", "it is not possible", "it would be against the rules", "it is not right"), ("for me to",), ("answer this", "write this code", "help with this", "provide a solution", "do this for you")),
            (("I",), ("decline", "refuse", "must decline", "have to refuse", "reject"), ("this request", "this task", "the request", "to answer", "to do this")),
        ),
        ("Please ask someone else.", "Please contact support.", "Is there anything else I can help you with?", "I hope you understand.", "", "", ""),
    ),
    "de": (
        ("Leider", "Es tut mir leid, aber", "Entschuldigung,", "Bedauerlicherweise", "Danke, aber", ""),
        ((("kann ich", "darf ich", "werde ich", "will ich"), ("diese Aufgabe", "dieses Programm", "diese Frage", "{1}", "das", "dabei"), ("nicht", "leider nicht"), ("lösen", "schreiben", "beantworten", "erledigen", "helfen")), (("Ich lehne", "Ich verweigere"), ("diese Anfrage", "diese Aufgabe"), ("ab", "leider ab"))),
        ("", "", "Bitte fragen Sie jemand anderen.", "Vielleicht hilft eine andere Person."),
    ),
    "es": (
        ("Lo siento,", "Lamentablemente", "Perdón, pero", "Por desgracia", "Gracias, pero", ""),
        ((("no puedo", "no quiero", "prefiero no", "no voy a", "no debo", "no me permiten", "me niego a"), ("resolver", "escribir", "responder a", "ayudar con", "completar", "hacer"), ("esta tarea", "este programa", "esta pregunta", "eso", "esta tarea sobre {1}", "la solución")),),
        ("", "", "Por favor, pregunta a otra persona.", "Quizás otra persona pueda ayudar."),
    ),
    "fr": (
        ("Désolé,", "Je regrette, mais", "Malheureusement,", "Pardon, mais", "Merci, mais", ""),
        ((("je ne peux pas", "je ne veux pas", "je préfère ne pas", "je ne vais pas", "je ne dois pas", "je refuse de", "je ne suis pas en mesure de"), ("résoudre", "écrire", "traiter", "fournir", "terminer", "faire"), ("cet exercice", "ce programme", "cette question", "cela", "ce programme sur les {1}", "la solution")),),
        ("", "", "Merci de demander à quelqu'un d'autre.", "Une autre personne pourra vous aider."),
    ),
    "pt": (
        ("Desculpe,", "Sinto muito, mas", "Infelizmente", "Perdão, mas", "Obrigado, mas", ""),
        ((("não posso", "não quero", "prefiro não", "não vou", "não devo", "não consigo", "recuso-me a"), ("resolver", "escrever", "responder", "ajudar com", "completar", "fazer"), ("esta tarefa", "este programa", "esta pergunta", "isso", "esta tarefa sobre {1}", "a solução")),),
        ("", "", "Por favor, pergunte a outra pessoa.", "Talvez outra pessoa possa ajudar."),
    ),
    "ru": (
        ("Извините,", "К сожалению,", "Простите, но", "Сожалею, но", "Спасибо, но", ""),
        ((("я не могу", "я не буду", "я не хочу", "мне нельзя", "я отказываюсь", "я предпочту не"), ("решать", "решить", "писать", "написать", "отвечать на", "выполнять"), ("эту задачу", "эту программу", "этот вопрос", "это", "задачу про {1}", "такое")),),
        ("", "", "Пожалуйста, спросите кого-нибудь другого.", "Возможно, поможет кто-то другой."),
    ),
}
_OTHER_PROGRAMS = (
    "function solve({1}) {{\n  let n = 3;\n  for (const x of {1}) {{\n    n += x;\n  }}\n  return n;\n}}", "const solve = ({1}) => {{\n  return {1}.length;\n}};", "public class Main {{\n    static int solve(int[] {1}) {{\n        return {1}.length;\n    }}\n}}",
    "#include <vector>\nint solve(std::vector<int>& {1}) {{\n    int n = 1;\n    return n;\n}}", "package main\n\nfunc solve({1} []int) int {{\n\treturn len({1})\n}}", "fn solve({1}: &[i64]) -> i64 {{\n    {1}.iter().sum()\n}}", "SELECT count(*) FROM {1} WHERE n > 3;", "<?php\nfunction solve(${1}) {{\n  return count(${1});\n}}",
)
_FOREIGN_PROSE = {
    "de": ["Die Schleife läuft einmal zu oft, weil die Grenze nicht geprüft wird.", "Der Wert wird nach dem ersten Durchlauf nie wieder auf null gesetzt.", "Für jede Zeile wird die Summe neu berechnet und mit dem Rest verglichen.", "Das Ergebnis ist um eins zu groß, wenn die Liste leer ist."],
    "es": ["El bucle se repite una vez de más porque no se comprueba el límite.", "El valor no vuelve a cero después de la primera vuelta.", "Para cada línea la suma se calcula de nuevo y se compara con el resto.", "El resultado es mayor de lo esperado cuando la lista está vacía."],
    "fr": ["La boucle tourne une fois de trop parce que la limite n'est pas vérifiée.", "La valeur n'est plus remise à zéro après le premier passage.", "Pour chaque ligne la somme est calculée de nouveau et comparée au reste.", "Le résultat est trop grand quand la liste est vide."],
    "pt": ["O laço roda uma vez a mais porque o limite não é verificado.", "O valor não volta a zero depois da primeira volta.", "Para cada linha a soma é calculada de novo e comparada com o resto.", "O resultado é maior do que o esperado quando a lista está vazia."],
    "ru": ["Цикл выполняется на один раз больше, потому что граница не проверяется.", "Значение не сбрасывается в ноль после первого прохода.", "Для каждой строки сумма вычисляется заново и сравнивается с остатком.", "Результат больше ожидаемого, если список пуст."],
    "en": ["The loop runs once too often because the limit is not checked.", "The value is never set back to zero after the first pass.", "For each line the sum is computed again and compared with the rest.", "The result is too large when the list is empty."],
}
#: Openers that speak of the writer or are sorry, before an answer that is sound.
_HEDGES = ("Sorry for the short note.", "I cannot find an exception, but the result is wrong.", "I cannot see why it stops, but the output differs.", "Unfortunately the result is off.", "I read the code twice.", "Sorry, this took a while.", "My reading is as follows.", "I am unable to reproduce the crash, but the value is wrong.", "I'm afraid the helper is wrong.", "We cannot rely on the first check.", "Thanks for asking.", "To be honest, one case was missed.")
_JUDGES = ("Does the program pass (answer pass or fail)?", "Judge the program. Answer with pass or fail.", "Decide: pass or fail?")
_EMPTY = (None, "", " ", "\n\n", "TODO", "N/A", "-", "...", "# your code here", "```python\n```")


def _refusal(rng: random.Random, topic: str) -> str:
    lang = "en" if rng.random() < 0.6 else rng.choice(list(_REFUSAL))
    openers, clauses, ends = _REFUSAL[lang]
    clause = " ".join(rng.choice(part) for part in rng.choice(clauses)).replace("{1}", topic)
    opener, end = rng.choice(openers), rng.choice(ends)
    clause = clause if opener and opener[-1] != "!" else clause[0].upper() + clause[1:]
    text = " ".join(x for x in (opener, clause + ".", end) if x)
    return text.lower() if rng.random() < 0.15 else text


def synthetic(prompt: str, answer: str, rng: random.Random, prose: dict[str, list[str]]) -> list[tuple[str | None, str | None, str | None]]:
    """A sound pair and its hedged, emptied, cut, refused, copied and swapped versions: (prompt, answer, label or None), VARIANTS at most; ``prose`` has sentences by language to swap in."""
    p, a = prompt, answer
    out: list[tuple[str | None, str | None, str | None]] = [(p, a, None)]
    program, verdict, explains = bool(S.PYTHON.search(a)), bool(_ASKS_VERDICT.search(p)), bool(_ASKS_PROSE.search(p))
    topic = rng.choice([w for w in set(G.WORD.findall(prompt_prose(p))) if len(w) > 3] or ["this"])
    if not program and not verdict:
        sentences = re.split(r"(?<=[.!?]) ", a)
        out.append((p, f"{rng.choice(_HEDGES)} {a if rng.random() < 0.5 else sentences[0]}", None))
        told = prompt_prose(p)
        own = prose[rng.choice(list(prose))]  # prompt and answer in one language, whichever it is
        if explains and told.strip() and rng.random() < 0.7:
            out.append((p.replace(told, told.split("\n")[0] + "\n\n" + " ".join(rng.sample(own, min(len(own), 5)))), " ".join(rng.sample(own, min(len(own), rng.randint(1, 4)))), None))
    elif rng.random() < 0.3:
        out.append((None, a, None))
    if rng.random() < 0.15:  # a verdict of one word is a whole answer
        out.append((f"{rng.choice(_JUDGES)}\n\n{prompt_prose(p).strip()}", rng.choice(("pass", "fail", "PASS", "Fail.", "Pass - no case fails.", "fail: the sum is wrong.")), None))
    if len(a) > 60:
        mark = rng.choice(("", "", "", "…", "\n# ... [truncated]", "<snip>"))
        for _ in range(8):
            cut = a[: rng.randint(len(a) // 5, len(a) * 19 // 20)].rstrip()
            x, _ = features(p, cut + mark)
            if x[[_AT[k] for k in ("open", "unterminated", "prose_open", "mark")]].any():  # a cut that can be seen
                out.append((p if rng.random() < 0.9 else None, cut + mark, "truncated"))
                break
    for _ in range(2):
        refusal, shape = _refusal(rng, topic), rng.random()
        out.append((p if rng.random() < 0.9 else None, refusal if shape < 0.6 else f"# {refusal}\npass" if shape < 0.8 else f"```\n{refusal}\n```", "refusal"))
    body, shape = p if rng.random() < 0.5 else task_text(p).strip(), rng.random()
    out.append((p, body if shape < 0.5 else body.lower() if shape < 0.7 else " ".join(body.split()) if shape < 0.85 else "# " + body.replace("\n", "\n# "), "copy"))
    if rng.random() < 0.2:  # the first line of a program is no answer yet
        out.append((p, f"{body.rstrip()}\n{rng.choice(('import sys', 'def solve(data):', 'class Solution:', 'from collections import Counter'))}\n", "copy"))
    mine = language(prompt_prose(p))
    if rng.random() < 0.6 or explains:
        foreign = prose[rng.choice([k for k in prose if k != mine])]
        swapped = " ".join(rng.sample(foreign, min(len(foreign), rng.randint(1, 5))))
        if mine and language(swapped) not in (None, mine):
            out.append((p, swapped, "other_language"))
    elif not verdict:
        code = rng.choice(_OTHER_PROGRAMS).format(p, topic)
        out.append((p if rng.random() < 0.9 else None, code if rng.random() < 0.7 else f"```\n{code}\n```", "other_language"))
    if rng.random() < 0.4:
        out.append((p, rng.choice(_EMPTY), "empty"))
    return out


def _sound(x: np.ndarray) -> bool:
    return not x[[_AT[k] for k in ("empty", "open", "unterminated", "prose_open", "mark", "other_code", "foreign", "copy_of_task", "no_code_for_code", "prose_for_verdict")]].any()


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(held, label, dense, dims) of the synthetic versions of sound pairs."""
    for pdf in batches:
        rows, prose = [], {k: list(v) for k, v in _FOREIGN_PROSE.items()}
        for p in pdf["prompt"]:
            told = prompt_prose(p)
            if (k := language(told)) is not None:
                prose[k] += [x for x in re.split(r"(?<=[.!?])\s+", told) if x.strip()]
        for key, p, a in zip(pdf["key"], pdf["prompt"], pdf["answer"]):
            if not p.strip() or not a.strip() or not _sound(features(p, a)[0]):
                continue
            rng = random.Random(key)
            held = rng.random() < 0.2
            made = synthetic(p, a, rng, prose)
            got = [features(q, b) for q, b, _ in made]
            row, dim = hashed([t for _, t in got])
            dims = np.split(dim, np.searchsorted(row, np.arange(1, len(made))))
            # where code is asked for, a part is learnt from the pair features alone, so that they don't lean on the words of the templates
            rows += [(held, LABELS.index(k) if k else -1, x.tolist(), [] if x[_AT["asks_code"]] and not held and not (k == "refusal" and x[_AT["foreign"]]) and rng.random() < MUTED else d.tolist()) for (_, _, k), (x, _), d in zip(made, got, dims)]
        yield pd.DataFrame(rows, columns=["held", "label", "dense", "dims"])


def fitted(rows: list) -> Model:
    """A model of (held, label, dense, dims) rows."""
    if not rows:
        return Model()
    dense = np.array([r[2] for r in rows], dtype=np.float32)
    n = np.array([len(r[3]) for r in rows])
    dim = np.concatenate([np.array(r[3], dtype=np.int64) for r in rows]) if n.sum() else np.zeros(0, dtype=np.int64)
    return Model().fit(dense, np.repeat(np.arange(len(rows)), n), dim, np.array([r[1] for r in rows]), np.array([r[0] for r in rows], dtype=bool))


def sample(rows: DataFrame, key: str) -> DataFrame:
    """The SAMPLE rows that come first by a hash of their key.  They are thinned by the hash first, so what tasks hand on doesn't grow with their number."""
    share = min(1.0, 3 * SAMPLE / max(1, rows.count()))
    thin = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(max(1, int(share * (1 << 30)))))
    return thin.orderBy(F.xxhash64(key, F.lit(1)), key).limit(SAMPLE)


def train(pairs: DataFrame) -> Model:
    """A model from (key, prompt, answer) of a bounded sample."""
    whole = pairs.where("prompt is not null and answer is not null").select("key", "prompt", "answer")
    spread = whole.repartition(2 * pairs.sparkSession.sparkContext.defaultParallelism, "key")
    made = spread.mapInPandas(_examples, "held boolean, label int, dense array<float>, dims array<int>")
    rows = made.orderBy("label", F.xxhash64("dense", "dims")).collect()  # VARIANTS a sampled pair at most; one order, so one model
    return fitted([tuple(r) for r in rows])


def find_defects(df: DataFrame, model: Model) -> DataFrame:
    """(src, key, defect) from (src, key, prompt, answer)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS x labels, whatever the data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = shared.value
        for pdf in batches:
            for k in range(0, len(pdf), 2000):
                part = pdf.iloc[k : k + 2000]
                prompts, answers = [[v if isinstance(v, str) else None for v in part[c]] for c in ("prompt", "answer")]
                got = part[["src", "key"]].assign(defect=m.label(prompts, answers))
                yield got[got["defect"].notna()]

    return df.select("src", "key", "prompt", "answer").mapInPandas(run, "src string, key string, defect string")


def sft_and_responses(sft: DataFrame, responses: DataFrame, problems: DataFrame) -> DataFrame:
    """(src, rec_id, defect) over both tables; every response is looked up in its problem's prompt."""
    a = sft.select(F.lit("sft_records").alias("src"), F.col("id").alias("key"), "prompt", F.col("completion").alias("answer")).where("key is not null")
    r = responses.select(F.lit("responses").alias("src"), F.col("response_id").alias("key"), "id", F.col("generated_code").alias("answer")).where("key is not null")
    prompts = problems.where("id is not null").groupBy("id").agg(F.min("prompt").alias("prompt"))
    columns = ("src", "key", "prompt", "answer")
    model = train(sample(a, "key").select(*columns).unionAll(sample(r, "key").join(prompts, "id").select(*columns)))
    looked_up = hot_joined(r, prompts, "id", F.col("key")).select(*columns)
    found = find_defects(a.unionAll(looked_up), model)
    return found.groupBy("src", "key").agg(F.min("defect").alias("defect")).select("src", F.col("key").alias("rec_id"), "defect")
