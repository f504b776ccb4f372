"""Parameters of the operators, and the fixed word lists and patterns.

Every operator takes one of the frozen dataclasses below; nothing is global state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
# Cleaning and splitting patterns.
URL_PATTERN = r"https?://\S+|www\.\S+"
CONTROL_PATTERN = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
NON_WORD_PATTERN = r"[^一-龥A-Za-z0-9]"
WORD_PATTERN = r"[\p{Alnum}一-龥]"
REPEAT_PATTERN = r"(.)\1{2,}"
CLAUSE_PATTERN = r"[，。！？；：、,.!?;:\n\r\t（）()「」“”\"'~…—\-]+"
AD_PATTERN = (
    r"微信|微.?信|weixin|\bwx\b|\bvx\b|v信|加我|私聊|私信|QQ|公众号|扫码|二维码|链接|网址|资源|种子|免费看|"
    r"在线看|下载|福利|领取|代刷|返现|优惠|折扣|包场|团购|票务|一手|全网|独家|客服|咨询|联系我|"
    r"www\.|http|\.com|\.cn|@\w+"
)
#: Characters with which a match of AD_PATTERN may begin, in either case: few of the ASCII ones, and
#: ideographs, which have no case. A range is tested faster than single characters.
AD_FIRST = r"wWvVqQhH.@一-龥"

# Strings pandas.read_csv treats as missing by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Sequence layout: <bos> PREFIX text MID sentiment SEP rating <eos>.
SPECIAL_TOKENS = ("<pad>", "<bos>", "<eos>", "<unk>")
PAD_ID, BOS_ID, EOS_ID, UNK_ID = 0, 1, 2, 3
PREFIX = "影评："
MID = "\n情感："
SEP = " 评分："
POSITIVE_CHAR, NEGATIVE_CHAR = "好", "差"
RATING_CHARS = "12345"
IGNORE_LABEL = -100

# Multiplier of the deterministic row-id hash.
HASH_MULTIPLIER = 2654435761

# Aspect -> trigger keywords.
ASPECT_KEYWORDS = {
    "剧情故事": "剧情 故事 剧本 情节 叙事 故事线 设定 桥段 编排 逻辑 铺垫 转折",
    "演技表演": "演技 表演 演绎 演得 演员 主演 男主角 女主角 配角 表演者 台词功底",
    "角色人物": "角色 人物 主角 性格 人设 形象 反派 配角塑造",
    "导演执导": "导演 执导 监制 编剧水平 把控 调度",
    "画面特效": "画面 特效 视觉 镜头 摄影 美术 场景 色彩 cg CG 3d 3D IMAX imax 视效",
    "配乐音效": "配乐 音乐 音效 插曲 主题曲 bgm BGM 声音 配音",
    "节奏剪辑": "节奏 剪辑 拖沓 冗长 紧凑 叙事节奏 时长 前戏",
    "台词对白": "台词 对白 金句 语录 梗 段子",
    "结局结尾": "结局 结尾 大结局 收尾 finale 开放式",
    "情感共鸣": "感动 共鸣 泪点 催泪 情怀 触动 暖心 治愈 代入感 共情",
    "笑点幽默": "笑点 搞笑 幽默 喜剧 好笑的 笑料 欢乐 段子手",
    "动作场面": "动作 打斗 战斗 打戏 场面 战争 爆破 追车 武打",
    "爱情感情线": "爱情 感情线 爱情线 恋爱 cp CP 甜 虐",
    "主题立意": "主题 立意 内核 深度 思想 价值观 意义 反思",
    "改编还原": "原著 改编 还原 小说 漫画 翻拍 IP 原版",
    "演员选角": "选角 casting 颜值 长相 造型 妆造 服装 服饰",
    "氛围风格": "氛围 风格 气质 色调 基调 压抑 惊悚 恐怖 悬疑感",
    "整体观感": "整体 全程 总体 观感 体验 一部 整部 影片 电影本身",
    "题材受众": "题材 受众 适合 儿童 小孩 家庭 合家欢 文艺片 商业片",
    "票价性价比": "票价 值不值 票价 浪费钱 性价比 票钱 值回",
    "广告植入": "广告 植入 尬 硬广 圈钱",
}

POSITIVE_WORDS = (
    "好 棒 赞 喜欢 精彩 惊艳 出色 优秀 完美 值得 感动 震撼 舒服 流畅 细腻 深刻 有趣 可爱 用心 诚意 经典 加分 "
    "惊喜 好看 好听 高级 扎实 稳 强 顶 爱了 泪目 封神 惊喜 满足 治愈 燃 爽"
)
NEGATIVE_WORDS = (
    "差 烂 无聊 尴尬 失望 难看 垃圾 拖沓 冗长 混乱 空洞 生硬 做作 出戏 敷衍 圈钱 烂片 崩溃 恶心 混乱 崩坏 拉胯 "
    "出戏 尬 平庸 老套 俗套 肤浅 浪费时间 后悔 睡着 稀烂 崩塌 无脑 崩"
)
STOP_WORDS = (
    "电影 片子 一部 这部 那部 整个 完全 真的 就是 还是 觉得 感觉 没有 什么 怎么 因为 所以 但是 不过 "
    "如果 这个 那个 我们 你们 他们 自己 一个 一直 一样 时候 已经 可以 不是 不能 不会 知道 看到 看完 看完之后 "
    "很多 有点 有些 非常 特别 比较 这么 那么 出来 出来 起来 上去 下来 东西 事情 地方 演员们 导演们 而且 然后 "
    "虽然 虽然 于是 于是乎 以及 或者 还有 其实 确实 简直 居然 竟然 真的 属实 最后 开始 时候 一切 那些 这些 "
    "影评 电影票 电影院 观众 大银幕 国内 中国 国产 好莱坞"
)

# Signal -> weight in hundredths. Whole numbers keep the threshold test exact.
SIGNAL_WEIGHTS = {
    "dup_same_movie": 55,
    "dup_cross_movie": 45,
    "template": 35,
    "ad": 60,
    "user_burst": 45,
    "user_repeat": 35,
    "movie_day_burst": 20,
    "rating_mismatch": 50,
    "like_bomb": 40,
    "low_info": 20,
}
# --- end of fixed values ----------------------------------------------------

SIGNALS = tuple(SIGNAL_WEIGHTS)


@dataclass(frozen=True)
class CleanConfig:
    min_chars: int = 4
    min_star: int = 1
    max_star: int = 5
    na_tokens: tuple[str, ...] = NA_TOKENS


@dataclass(frozen=True)
class LabelConfig:
    positive_min: int = 4
    negative_max: int = 2
    neutral: int = 3


@dataclass(frozen=True)
class SplitConfig:
    buckets: int = 1000
    val_below: int = 10
    train_below: int = 200


@dataclass(frozen=True)
class SequenceConfig:
    max_len: int = 144
    vocab_size: int = 8000
    min_freq: int = 3
    prefix: str = PREFIX
    mid: str = MID
    sep: str = SEP


@dataclass(frozen=True)
class BatchConfig:
    batch_size: int = 128
    token_budget: int = 8192
    bucket_width: int = 16
    min_batch: int = 8


@dataclass(frozen=True)
class SentimentLexicon:
    """Positive and negative words. With ``whole_words`` a hit is a whole run of a-z letters
    in the lower-cased text; without it a hit is any non-overlapping substring."""

    positive: tuple[str, ...] = tuple(dict.fromkeys(POSITIVE_WORDS.split()))
    negative: tuple[str, ...] = tuple(dict.fromkeys(NEGATIVE_WORDS.split()))
    whole_words: bool = False


@dataclass(frozen=True)
class AspectConfig:
    """``lexicon`` maps an aspect to its keywords and is bounded by the code that states it.
    ``clauses_per_review`` and ``sample_per_item`` are off: every clause of every review counts."""

    lexicon: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {a: tuple(k.split()) for a, k in ASPECT_KEYWORDS.items()}
    )
    clause_pattern: str = CLAUSE_PATTERN
    min_clause_chars: int = 3
    clauses_per_review: int | None = None
    sample_per_item: int | None = None
    seed: int = 42
    evidence: int = 3
    min_mentions: int = 30
    positive_rate: float = 0.60
    negative_rate: float = 0.40
    top_aspects: int = 6
    weak_aspects: int = 2
    evidence_shown: int = 2


@dataclass(frozen=True)
class SegmentConfig:
    """``max_words`` bounds the mined dictionary, the most frequent words first, as a vocabulary
    size does; with the characters (at most 20,902) it is what every task holds."""

    max_chars: int = 4
    min_count: int = 5
    min_pmi: float = 1.0
    min_entropy: float = 0.5
    max_words: int = 200_000


@dataclass(frozen=True)
class KeywordConfig:
    segments: SegmentConfig = SegmentConfig()
    stop_words: tuple[str, ...] = tuple(dict.fromkeys(STOP_WORDS.split()))
    min_chars: int = 2
    min_count: int = 5
    prior: float = 0.01
    top: int = 12
    shown: int = 10


@dataclass(frozen=True)
class RatingConfig:
    prior_weight: int = 100
    star_share: float = 0.6
    model_share: float = 0.4


@dataclass(frozen=True)
class SpamConfig:
    weights: dict[str, int] = field(default_factory=lambda: dict(SIGNAL_WEIGHTS))
    suspect_at: int = 50
    ad_pattern: str = AD_PATTERN
    dup_same_min: int = 2
    dup_cross_items: int = 3
    template_min: int = 5
    template_chars: int = 12
    burst_min: int = 5
    repeat_min: int = 3
    day_quantile: float = 0.999
    day_over: str = "rows"
    confident_positive: float = 0.9
    confident_negative: float = 0.1
    bomb_likes: int = 300
    bomb_chars: int = 15
    low_info_chars: int = 5
    ignore_empty: bool = False
    top_suspects: int = 8
    shown_chars: int = 80
