"""Chat templates and their rendering as one expression over an ordered array of messages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import strip, strip_left

STYLES = ("SINGLE", "TWO", "MPT", "PLAIN", "LLAMA_2", "QWEN_2", "CHATML")


@dataclass(frozen=True)
class Template:
    name: str
    style: str
    system: str
    roles: tuple[str, str]
    sep: str
    sep2: str | None = None
    version: str = "Unknown"
    shots: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.style not in STYLES:
            raise ValueError(f"no such style: {self.style}")

    @property
    def offset(self) -> int:
        return len(self.shots)


# System texts, roles and separators of the registered templates.
HUMAN = "A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions."
USER = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
TAGGED = "A chat between a curious user and an artificial intelligence assistant. The assistant is able to understand the visual content that the user provides, and assist the user with a variety of tasks using natural language.The visual content will be provided with the following format: <Image>visual content</Image>."
SAFE = "You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe.  Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. Please ensure that your responses are socially unbiased and positive in nature.\n\nIf a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. If you don't know the answer to a question, please don't share false information."
VISION = "You are a helpful language and vision assistant. You are able to understand the visual content that the user provides, and assist the user with a variety of tasks using natural language."
MPT_SYSTEM = "<|im_start|>system\nA conversation between a user and an LLM-based AI assistant. The assistant gives helpful and honest answers."
DIRECT = "<|im_start|>system\nAnswer the questions."
QWEN = "<|im_start|>system\nYou are a helpful assistant."
IM = ("<|im_start|>user\n", "<|im_start|>assistant\n")
TITLE, UPPER = ("Human", "Assistant"), ("USER", "ASSISTANT")
SHOTS = (
    "What are the key differences between renewable and non-renewable energy sources?",
    "Renewable energy sources are those that can be replenished naturally in a relatively short amount of time, such as solar, wind, hydro, geothermal, and biomass. Non-renewable energy sources, on the other hand, are finite and will eventually be depleted, such as coal, oil, and natural gas. Here are some key differences between renewable and non-renewable energy sources:\n1. Availability: Renewable energy sources are virtually inexhaustible, while non-renewable energy sources are finite and will eventually run out.\n2. Environmental impact: Renewable energy sources have a much lower environmental impact than non-renewable sources, which can lead to air and water pollution, greenhouse gas emissions, and other negative effects.\n3. Cost: Renewable energy sources can be more expensive to initially set up, but they typically have lower operational costs than non-renewable sources.\n4. Reliability: Renewable energy sources are often more reliable and can be used in more remote locations than non-renewable sources.\n5. Flexibility: Renewable energy sources are often more flexible and can be adapted to different situations and needs, while non-renewable sources are more rigid and inflexible.\n6. Sustainability: Renewable energy sources are more sustainable over the long term, while non-renewable sources are not, and their depletion can lead to economic and social instability.\n",
)
TEMPLATES = {
    t.name: t
    for t in (
        Template("default", "QWEN_2", QWEN, IM, "<|im_end|>\n", version="qwen_v2"),
        Template("v0", "SINGLE", HUMAN, TITLE, "###", shots=SHOTS),
        Template("v1", "TWO", USER, UPPER, " ", "</s>", "v1"),
        Template("vicuna_v1", "TWO", USER, UPPER, " ", "</s>", "v1"),
        Template("qwen_2", "QWEN_2", QWEN, IM, "<|im_end|>\n", version="qwen_v2"),
        Template("llama_2", "LLAMA_2", SAFE, UPPER, "<s>", "</s>", "llama_v2"),
        Template("mistral_instruct", "LLAMA_2", "", UPPER, "", "</s>", "llama_v2"),
        Template("chatml_direct", "MPT", DIRECT, IM, "<|im_end|>", version="mpt"),
        Template("mistral_direct", "MPT", DIRECT, IM, "<|im_end|>", version="mpt"),
        Template("plain", "PLAIN", "", ("", ""), "\n"),
        Template("v0_plain", "PLAIN", "", ("", ""), "\n"),
        Template("llava_v0", "SINGLE", HUMAN, TITLE, "###"),
        Template("v0_mmtag", "SINGLE", TAGGED, TITLE, "###", version="v0_mmtag"),
        Template("llava_v1", "TWO", HUMAN, UPPER, " ", "</s>", "v1"),
        Template("v1_mmtag", "TWO", TAGGED, UPPER, " ", "</s>", "v1_mmtag"),
        Template("llava_llama_2", "LLAMA_2", VISION, UPPER, "<s>", "</s>", "llama_v2"),
        Template("mpt", "MPT", MPT_SYSTEM, IM, "<|im_end|>", version="mpt"),
    )
}
IMAGE = "<image>"


def template_table(spark: SparkSession) -> DataFrame:
    """The registry as a table of 17 rows."""
    return spark.createDataFrame([(t.name, t.style, t.system, t.roles[0], t.roles[1], t.sep, t.sep2, t.version, t.offset) for t in TEMPLATES.values()], "name string, style string, system string, role0 string, role1 string, sep string, sep2 string, version string, offset int")


def render(t: Template, messages: Column) -> Column:
    """The prompt of ``messages``, an ordered array<struct<role, text>>; an empty text leaves the role to be answered."""
    said = lambda m: F.length(F.coalesce(m["text"], F.lit(""))) > 0
    alternate = lambda i: F.when(i % 2 == 0, F.lit(t.sep)).otherwise(F.lit(t.sep2).cast("string"))
    joined = lambda f: F.array_join(F.transform(messages, f), "")
    head = F.lit(t.system + t.sep)
    if t.style == "SINGLE":
        return F.concat(head, joined(lambda m: F.when(said(m), F.concat(m["role"], F.lit(": "), m["text"], F.lit(t.sep))).otherwise(F.concat(m["role"], F.lit(":")))))
    if t.style in ("QWEN_2", "MPT"):
        return F.concat(head, joined(lambda m: F.when(said(m), F.concat(m["role"], m["text"], F.lit(t.sep))).otherwise(m["role"])))
    if t.style == "CHATML":
        return F.concat(F.lit(t.system and t.system + t.sep + "\n"), joined(lambda m: F.when(said(m), F.concat(m["role"], F.lit("\n"), m["text"], F.lit(t.sep + "\n"))).otherwise(F.concat(m["role"], F.lit("\n")))))
    if t.style == "TWO":
        return F.concat(head, joined(lambda m, i: F.when(said(m), F.concat(m["role"], F.lit(": "), m["text"], alternate(i))).otherwise(F.concat(m["role"], F.lit(":")))))
    if t.style == "PLAIN":
        pieces = F.transform(messages, lambda m, i: F.when(said(m), F.concat(m["text"], alternate(i))).otherwise(F.lit("")))
        # an answer needs the second separator: without one there is no prompt
        return F.when(~F.exists(pieces, lambda p: p.isNull()), F.concat(F.lit(t.system), F.array_join(pieces, "")))
    system = f"<<SYS>>\n{t.system}\n<</SYS>>\n\n" if t.system else ""
    turn = lambda m, i: F.when(~said(m), F.lit("")).when(i % 2 == 0, F.concat(F.lit(t.sep + "[INST] "), F.when(i == 0, F.lit(system)).otherwise(F.lit("")), m["text"], F.lit(" [/INST]"))).otherwise(F.concat(F.lit(" "), m["text"], F.lit(" "), F.lit(t.sep2)))
    first = messages[0]
    return F.when(said(first) & (first["role"] == t.roles[0]), strip_left(joined(turn), t.sep))


def with_image_first(t: Template, messages: Column) -> Column:
    """Messages of a conversation whose first one carries an image: tagged templates announce it in turns of its own."""
    text = strip(F.replace(messages[0]["text"], F.lit(IMAGE), F.lit("")))
    made = lambda role, words: F.struct(F.lit(role).alias("role"), words.alias("text"))
    rest = F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))
    if "mmtag" in t.version:
        return F.concat(F.array(made(t.roles[0], F.lit("<Image><image></Image>")), made(t.roles[1], F.lit("Received.")), F.struct(messages[0]["role"].alias("role"), text.alias("text"))), rest)
    return F.concat(F.array(F.struct(messages[0]["role"].alias("role"), F.concat(F.lit(IMAGE + "\n"), text).alias("text"))), rest)


def with_image_marks(text: Column, images: Column) -> Column:
    """A message of the CHATML style with a mark for each of its images in front."""
    return F.concat(F.repeat(F.lit(IMAGE), images.cast("int")), F.coalesce(text, F.lit("")))


def interleaved(prompt: Column, images: Column) -> Column:
    """Pieces of a prompt between image marks, each followed by its image as long as there are any."""
    pieces = F.split(F.replace(prompt, F.lit(f" {IMAGE}\n"), F.lit(IMAGE)), IMAGE)
    return F.flatten(F.transform(pieces, lambda p, i: F.when(i < F.size(images), F.array(p, F.get(images, i))).otherwise(F.array(p))))


def image_to_front(text: Column, tagged: bool = False, start_end: bool = False) -> Column:
    """Put the image mark on a line of its own before a message that has one."""
    moved = strip(F.concat(F.lit(IMAGE + "\n"), strip(F.replace(text, F.lit(IMAGE), F.lit("")))))
    if tagged:
        moved = F.replace(moved, F.lit(IMAGE), F.lit(f"<Image>{IMAGE}</Image>"))
    out = F.when(text.contains(IMAGE), moved).otherwise(text)
    return F.replace(out, F.lit(IMAGE), F.lit(f"<im_start>{IMAGE}<im_end>")) if start_end else out


def template_of_model(name: Column, web: bool = False) -> Column:
    """Template for a model's name, by the order of the rules of the terminal or the web client; unregistered ones are null."""
    low = F.lower(name)
    has = lambda *parts: reduce(or_, (low.contains(p) for p in parts))
    if not web:
        return F.when(has("llama-2"), "llava_llama_2").when(has("mistral"), "mistral_instruct").when(has("v1.6-34b"), "chatml_direct").when(has("v1"), "llava_v1").when(has("mpt"), "mpt").otherwise("llava_v0")
    tagged = has("mmtag") | (has("plain") & ~has("finetune"))
    vision = (
        F.when(has("llama-2"), "llava_llama_2")
        .when(has("mistral", "mixtral"), F.when(has("orca"), F.lit(None).cast("string")).when(has("hermes"), "chatml_direct").otherwise("mistral_instruct"))
        .when(has("llava-v1.6-34b"), "chatml_direct")
        .when(has("v1"), F.when(tagged, "v1_mmtag").otherwise("llava_v1"))
        .when(has("mpt"), "mpt")
        .otherwise(F.when(tagged, "v0_mmtag").otherwise("llava_v0"))
    )
    return F.when(has("llava"), vision).when(name.contains("mpt"), F.lit(None).cast("string")).when(name.contains("llama-2"), "llama_2").otherwise("vicuna_v1")
