"""Chat samples as nested columns: fields, content lists, messages, rendering."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from captrellis.functions.hashing import pick

ELEMENT = "struct<type:string,image:string,text:string>"
CONTENT = f"array<{ELEMENT}>"
MESSAGES = f"array<struct<role:string,content:{CONTENT}>>"

# Fixed value: the system message of every sample.
SYSTEM_MESSAGE = """You are a Vision Language Model specialized in image captioning task. Please be thorough and 
descriptive in your captions. Your task is to analyze the provided image and respond with a detailed caption that
describes the content of the image."""

# Fixed value: the question of every evaluation sample.
EVAL_QUESTION = (
    "Please generate an accurate caption using 10-15 words. Just focus on main object and key features in the image."
)

# The wording in front of the first and the second example (one and two spaces at the end).
FIRST_EXAMPLE = "I'll show you few examples of image-caption pairs. here is the first example caption - "
SECOND_EXAMPLE = "I'll show you few examples of image-caption pairs. here is the second example caption -  "

# The prompts a plain caption is paired with.
PROMPTS = [
    "please describe what you observe in this image.",
    "give a detailed explanation of the scene in this picture.",
    "could you summarize the contents of this image in a few sentences?",
    "how would you describe this image to someone who can't see it?",
    "provide a detailed summary of what this picture shows.",
    "in a few sentences, explain what's happening in this image.",
    "could you briefly explain the scene captured in this image?",
    "describe the key elements and details visible in this picture.",
    "offer a short description of what you notice in this image.",
    "in 4-5 sentences, summarize the main aspects of this photo.",
    "give a quick overview of what this image is about.",
    "could you detail the important parts you observe in this picture?",
    "please share a concise summary of this image.",
    "write a few lines describing what you see in this photograph.",
    "summarize the overall scene depicted in this image.",
    "in 4-5 sentences, describe the important features of this image.",
    "briefly describe what is happening in this picture.",
    "what do you see in this image? describe it in a few sentences.",
    "explain what this image portrays in a short paragraph.",
    "give a clear and detailed description of this photo.",
]


@dataclass(frozen=True)
class Template:
    """How messages become one prompt string; every part is configurable."""

    role_prefix: dict[str, str] = field(
        default_factory=lambda: {"system": "System: ", "user": "User: ", "assistant": "Assistant: "}
    )
    image_marker: str = "<image>"
    end_of_turn: str = "<end_of_utterance>\n"
    generation_suffix: str = "Assistant:"


def random_prompt(seed: int | str, *keys: Column | str) -> Column:
    """One of the fixed prompts, drawn by the row key."""
    return F.get(F.array(*[F.lit(p) for p in PROMPTS]), pick(len(PROMPTS), seed, *keys).cast("int"))


def fields(
    columns: list[str], keys: list[str], seed: int | str = 0, test_set: bool = False
) -> tuple[Column, Column, Column]:
    """``(image, user_text, assistant)`` for a table with the given columns.

    * ``test_set``: the fixed question and the list of answers;
    * dialogue rows (``texts`` not NULL): user and assistant of the first turn;
    * caption rows: a random prompt and the caption.

    A table may hold both kinds of rows if it has both ``texts`` and ``caption``.
    """

    def need(*names: str) -> None:
        lacking = [c for c in names if c not in columns]
        if lacking:
            raise ValueError(f"columns {lacking} not found. Available columns: {columns}")

    if test_set:
        need("image", "answer")
        return F.col("image"), F.lit(EVAL_QUESTION), F.col("answer")
    need("image_path")
    prompt = random_prompt(seed, *keys)
    turn = F.get(F.col("texts"), 0) if "texts" in columns else None
    if turn is None:
        need("caption")
        return F.col("image_path"), prompt, F.col("caption")
    if "caption" not in columns:
        return F.col("image_path"), turn["user"], turn["assistant"]
    dialogue = F.col("texts").isNotNull()
    return (
        F.col("image_path"),
        F.when(dialogue, turn["user"]).otherwise(prompt),
        F.when(dialogue, turn["assistant"]).otherwise(F.col("caption")),
    )


def image_element(image: Column) -> Column:
    return F.struct(
        F.lit("image").alias("type"), image.cast("string").alias("image"), F.lit(None).cast("string").alias("text")
    )


def text_element(text: Column) -> Column:
    return F.struct(
        F.lit("text").alias("type"), F.lit(None).cast("string").alias("image"), text.cast("string").alias("text")
    )


def few_shot_prefix(
    first_image: Column, first_caption: Column, second_image: Column, second_caption: Column
) -> Column:
    """Four elements that show two example captions; both captions must exist."""
    return F.array(
        image_element(first_image),
        text_element(F.concat(F.lit(FIRST_EXAMPLE), first_caption)),
        image_element(second_image),
        text_element(F.concat(F.lit(SECOND_EXAMPLE), second_caption)),
    )


def few_shot_from_answers(shots: Column, strict_compat: bool = True) -> Column:
    """Prefix from ``shots``, an array of ``struct<image, answer: array>``.

    Uses the first answer of the first example and the second answer of the
    second one; further examples are ignored, and a NULL or empty array gives no
    prefix. ``strict_compat`` shows the first example's image twice; otherwise
    each example keeps its own image. Too few examples or answers are an error.
    """
    first, second = F.get(shots, 0), F.get(shots, 1)
    one, two = F.get(first["answer"], 0), F.get(second["answer"], 1)
    usable = one.isNotNull() & two.isNotNull()
    prefix = few_shot_prefix(first["image"], one, first["image"] if strict_compat else second["image"], two)
    problem = F.raise_error(F.lit("few-shot examples need two rows and two answers on the second")).cast(CONTENT)
    return F.when(F.size(shots) > 0, F.when(usable, prefix).otherwise(problem))


def content(image: Column, text: Column, few_shot: Column | None = None) -> Column:
    """Content list of the user turn, after an optional few-shot prefix."""
    current = F.array(image_element(image), text_element(text))
    if few_shot is None:
        return current
    return F.concat(F.coalesce(few_shot, F.array().cast(CONTENT)), current)


def messages(
    image: Column, user_text: Column, assistant_text: Column, few_shot: Column | None = None,
    system_message: str = SYSTEM_MESSAGE,
) -> Column:
    """System, user and assistant message of one sample."""

    def message(role: str, body: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), body.alias("content"))

    return F.array(
        message("system", F.array(text_element(F.lit(system_message)))),
        message("user", content(image, user_text, few_shot)),
        message("assistant", F.array(text_element(assistant_text))),
    )


def gather_images(msgs: Column) -> Column:
    """Images of all messages in order."""
    elements = F.flatten(F.transform(msgs, lambda m: m["content"]))
    return F.transform(F.filter(elements, lambda e: e["type"] == "image"), lambda e: e["image"])


def prompt_part(msgs: Column) -> Column:
    """The user message alone, without system message and answer."""
    return F.slice(msgs, 2, 1)


def answer_text(msgs: Column) -> Column:
    """Ground truth: text of the assistant message."""
    return F.get(F.get(msgs, 2)["content"], 0)["text"]


def image_of(msgs: Column) -> Column:
    """Image of the user message."""
    return F.get(F.get(msgs, 1)["content"], 0)["image"]


def render(msgs: Column, template: Template = Template(), add_generation_prompt: bool = False) -> Column:
    """Messages as one prompt string without outer white space."""
    prefix = F.create_map(*[F.lit(x) for pair in template.role_prefix.items() for x in pair])

    def element(e: Column) -> Column:
        return F.when(e["type"] == "image", F.lit(template.image_marker)).otherwise(F.coalesce(e["text"], F.lit("")))

    turns = F.transform(
        msgs,
        lambda m: F.concat(
            F.coalesce(F.try_element_at(prefix, m["role"]), F.lit("")),
            F.array_join(F.transform(m["content"], element), ""),
            F.lit(template.end_of_turn),
        ),
    )
    whole = F.array_join(turns, "")
    if add_generation_prompt:
        whole = F.concat(whole, F.lit(template.generation_suffix))
    # Same characters as Python's str.strip() for ASCII text.
    return F.trim(whole, F.lit(" \t\n\r\x0b\x0c"))
