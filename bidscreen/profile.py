"""Patterns, keyword lists and thresholds of a language: everything that the operators take as given.

`ZH` screens Chinese tender documents; `LATIN` screens texts in Latin script with one paragraph a line.
Patterns are Java regular expressions for Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# Patterns, keywords, weights and thresholds that decide results.
ZH_SECTIONS = (
    r"^第[一二三四五六七八九十百千\d]+[章节条款]\s*[：:]?\s*(.+)$",
    r"^[一二三四五六七八九十]+[、.．]\s*(.+)$",
    r"^(\d+)\.\s*(.+)$",
    r"^(\d+\.\d+)\s+(.+)$",
    r"^[\(（]\s*[一二三四五六七八九十\d]+\s*[\)）]\s*(.+)$",
)
ZH_LEGAL = (r"《[^》]{2,30}法》", r"《[^》]{2,30}条例》", r"《[^》]{2,30}规定》", r"《[^》]{2,30}办法》", r"第[一二三四五六七八九十百\d]+条[^\w]")
ZH_STANDARD = (r"GB/T\s*\d{4,6}", r"GB\s*\d{4,6}", r"YY/T\s*\d{4,6}", r"YY\s*\d{4,6}", r"ISO\s*\d{4,6}", r"ISO/IEC\s*\d{4,6}", r"IEC\s*\d{4,6}", r"WS/T\s*\d{4,6}")
ZH_PRICE_WORDS = ("报价", "单价", "总价", "含税价", "不含税", "预算", "投标价", "元/", "万元", "RMB", "人民币", "报价单", "价格表")
ZH_TECH_WORDS = ("技术参数", "技术规格", "技术要求", "性能指标", "配置要求", "功能要求", "精度", "分辨率", "灵敏度", "量程", "通道", "频率", "功率", "电压", "电流", "接口", "协议", "兼容")
ZH_COMPANY = r"[一-龥A-Za-z0-9（）()·\-]{2,20}(?:有限公司|股份公司|有限责任公司|集团公司|科技公司|工程公司|建设公司)"
ZH_PROJECT = r"[一-龥A-Za-z0-9（）()·\-]{4,40}(?:项目|工程|采购|招标)"
ZH_PERSONS = (r"联系人[：:]\s*([一-龥]{2,4})", r"(?:项目经理|负责人|联系人)[：:]\s*([一-龥]{2,4})")
ZH_TEAM = (
    r"(?:项目经理|项目负责人)[：:\s]\s*([一-龥]{2,4})",
    r"(?:系统架构师|技术架构师|首席架构师)[：:\s]\s*([一-龥]{2,4})",
    r"(?:实施顾问|交付经理|售前顾问|实施经理)[：:\s]\s*([一-龥]{2,4})",
    r"(?:测试工程师|测试经理|质量工程师)[：:\s]\s*([一-龥]{2,4})",
    r"(?:运维工程师|运维经理|安全工程师)[：:\s]\s*([一-龥]{2,4})",
    r"(?:数据库工程师|数据架构师)[：:\s]\s*([一-龥]{2,4})",
)
ZH_QUANTITY = r"\d+(?:\.\d+)?\s*(?:小时|分钟|天|日|年|月|家|个|项|套|台|件|次|人|%|％|万|亿|千|百)(?:响应|解决|处理|维修|上门|供应商|合作|服务|案例|经验|保障|运维|测试|支持)?"
#: Stop lists as they are given. Of the grams only those of four characters can match.
ZH_STOP_GRAMS = (
    "本公司承诺", "严格按照", "相关法律法", "法律法规的", "律法规的规", "规的规定执",
    "的规定执行", "符合招标文", "招标文件要", "文件要求的", "我公司将严", "公司将严格",
    "将严格按照", "提供优质的", "优质的服务", "质量保证期", "量保证期内", "保证期内免",
    "证期内免费", "期内免费维", "内免费维修", "免费维修更", "费维修更换",
    "的技术支持", "技术支持和", "本次投标的", "次投标的产",
)
ZH_STOP_WORDS = (
    "的", "了", "和", "是", "在", "我", "有", "就", "不", "人", "都", "一",
    "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着",
    "没有", "看", "好", "自己", "这", "那", "这个", "那个", "但", "与",
    "及", "或", "等", "对", "以", "为", "因", "所", "如", "其", "而",
    "时", "中", "将", "进行", "提供", "需要", "应当", "应该", "必须",
    "可以", "要求", "按照", "根据", "通过", "相关", "具体", "以上",
)
ZH_TOTALS = r"合计|总价|报价总额|投标总价|总报价|总金额|含税总价"
AMOUNT = r"(?:[¥￥]|人民币)?\s*(\d+(?:,\d{3})*(?:\.\d+)?)\s*(万元|亿元|元|元整)?"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


@dataclass(frozen=True)
class Profile:
    """What a language brings. Java's \\w, \\s and \\d are Unicode's only under (?U), which `u` puts before a pattern."""

    name: str = "zh"
    paragraph_split: str = r"(?dm)\n{2,}|^[-=─━]{3,}(?U)\s*$"
    sentence_split: str = r"(?<=[。；！？])"
    sections: tuple[str, ...] = ZH_SECTIONS
    legal: tuple[str, ...] = ZH_LEGAL
    standard: tuple[str, ...] = ZH_STANDARD
    price_words: tuple[str, ...] = ZH_PRICE_WORDS
    tech_words: tuple[str, ...] = ZH_TECH_WORDS
    phone: str = r"1[3-9]\d{9}"
    email: str = EMAIL
    company: str = ZH_COMPANY
    project: str = ZH_PROJECT
    #: Words of which every match of company or project has one; no match goes past a line. Lines without are passed over.
    company_words: tuple[str, ...] = ("公司",)
    project_words: tuple[str, ...] = ("项目", "工程", "采购", "招标")
    persons: tuple[str, ...] = ZH_PERSONS
    team: tuple[str, ...] = ZH_TEAM
    gram_run: str = r"[一-龥]{4,}"
    gram_size: int = 4
    gram_words: bool = False
    stop_grams: tuple[str, ...] = ZH_STOP_GRAMS
    quantity: str = ZH_QUANTITY
    totals: str = ZH_TOTALS
    token: str = r"[A-Za-z0-9]+|[一-龥]+"
    stop_words: tuple[str, ...] = ZH_STOP_WORDS
    heading_mark: str = "§H§"
    table_mark: str = "[表格]"
    header_mark: str = "[表格标题]"
    no_section: str = "未知章节"
    cut_mark: str = "…（已截断）"
    # Lengths and thresholds that decide results.
    max_chars: int = 800
    min_chars: int = 20
    min_chars_refs: int = 10
    window: int = 600
    step: int = 300
    list_items: int = 5
    min_merged: int = 10
    max_title: int = 100
    rare_count: int = 2
    min_amount: float = 100.0
    fuzzy: float = 0.80

    @staticmethod
    def u(pattern: str) -> str:
        return "(?U)" + pattern

    def any_of(self, patterns: tuple[str, ...]) -> str:
        return self.u("|".join(f"(?:{p})" for p in patterns))


ZH = Profile()
LATIN = replace(
    ZH,
    name="latin",
    paragraph_split=r"\n+",
    sentence_split=r"(?<=[.!?])",
    sections=(r"^[A-Z][^.!?|]{3,60}$",),
    legal=(r"[Ll]icen[cs]e", r"[Cc]opyright"),
    standard=(r"ISO\s*\d{4,6}", r"RFC\s*\d{3,5}"),
    price_words=("price", "total", "USD", "EUR"),
    tech_words=("sensor", "voltage", "protocol", "interface"),
    phone=r"\+\d+ \(\d{3}\) \d{3}-\d{4}",
    company=r"[A-Z][A-Za-z]+ (?:Inc|Ltd|GmbH)",
    project=r"[A-Z][a-z]+ [Pp]roject",
    company_words=("Inc", "Ltd", "GmbH"),
    project_words=("roject",),
    persons=(r"[Cc]ontact: ([A-Z][a-z]+)",),
    team=(r"[Mm]anager: ([A-Z][a-z]+)",),
    gram_run=r"[^\x20\x09-\x0D]+",
    gram_size=3,
    gram_words=True,
    stop_grams=(),
    quantity=r"\d+(?:\.\d+)? (?:hours|days|years|%)",
    token=r"[\p{L}\p{N}]+",
    stop_words=("the", "and", "der", "die", "das", "und", "les", "des", "los", "las", "que"),
)
