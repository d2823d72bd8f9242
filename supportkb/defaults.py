"""Word lists and rules that results depend on, kept as plain text. All of them are
parameters of the operators that use them."""

# Words that mark a conversation as work. Repeats count twice.
WORK_KEYWORDS = [
    "售后", "返品", "返金", "交換", "新品", "発送", "配送", "到着", "商品", "不良", "故障", "保証", "レビュー", "星", "評価", "お客様", "申し訳",
    "アマゾン", "amazon", "asin", "領星", "注文", "注文番号", "物流", "邮便番号", "住所", "電話番号", "部品", "説明書", "取扱説明書", "充電",
    "バッテリー", "電源", "お手入れ", "フィルター", "風量", "温度", "モード", "ボタン", "ランプ", "ドライヤー", "扇風機", "サーキュレーター", "加湿器",
    "空気清浄機", "電動", "吹风机", "循环扇", "加湿器", "空气净化器", "充电", "说明书", "配件", "退货", "退款", "发新", "补发", "赔偿", "客户", "客人",
    "亚马逊", "差评", "模板", "回复", "日文", "日本語", "中文", "翻译", "话术", "対応", "お問い合わせ", "运营", "listing", "标题", "五点", "关键词",
    "关键词", "文案", "图片", "主图", "A+", "竞品", "競合", "调研", "市场", "選品", "选品", "销量", "売上", "销售", "排名", "ランキング", "bsr",
    "秒杀", "deal", "クーポン", "优惠券", "广告", "広告", "ppc", "cpc", "转化", "転換", "点击", "クリック", "库存", "在庫", "补货", "入荷",
    "発注", "fba", "fbm", "海外仓", "仓库", "倉庫", "物流单号", "SKU", "sku", "upc", "ean", "品牌", "ブランド", "パッケージ", "包装",
    "说明书", "说明书修改", "取扱説明書", "规格书", "仕様書", "发票", "領収書",
]

# Words that mark a conversation as private.
IRRELEVANT_HINTS = [
    "菜谱", "食谱", "做饭", "旅游", "旅行", "电影", "音乐", "游戏攻略", "学习英语", "背单词", "健身", "减肥", "恋爱", "天气", "新闻", "明星", "八卦",
    "笑话", "故事", "作文", "PPT模板", "简历", "面试", "考研",
]

# Words that make a conversation title worth keeping.
TITLE_KEYWORDS = [
    "售后", "返品", "返金", "交換", "新品", "発送", "配送", "到着", "商品", "不良", "故障", "保証", "レビュー", "星", "評価", "お客様", "申し訳",
    "アマゾン", "amazon", "asin", "領星", "注文", "物流", "邮便", "住所", "電話", "部品", "説明書", "取扱説明書", "充電", "バッテリー", "電源",
    "風量", "温度", "モード", "ボタン", "ランプ", "ドライヤー", "扇風機", "サーキュレーター", "加湿器", "空気清浄機", "電動", "吹风机", "循环扇", "加湿器",
    "空气净化器", "充电", "说明书", "配件", "退货", "退款", "发新", "补发", "赔偿", "客户", "客人", "亚马逊", "差评", "模板", "回复", "日文", "日本語",
    "中文", "翻译", "话术", "対応", "お問い合わせ", "运营", "listing", "标题", "五点", "关键词", "文案", "图片", "主图", "a+", "竞品", "競合",
    "调研", "市场", "選品", "选品", "销量", "売上", "销售", "排名", "ランキング", "bsr", "秒杀", "deal", "クーポン", "优惠券", "广告", "広告",
    "ppc", "cpc", "转化", "転換", "点击", "クリック", "库存", "在庫", "补货", "入荷", "発注", "fba", "fbm", "海外仓", "仓库", "倉庫",
    "sku", "upc", "ean", "品牌", "ブランド", "パッケージ", "包装", "规格书", "仕様書", "发票", "領収書", "客户反馈", "客诉", "投诉", "商品页面",
    "listing", "コンバージョン", "売れ行き", "广告优化", "亚马逊日本", "日本站", "视频", "分析", "优化", "建议", "问题", "排查", "原因", "处理", "方案",
]

# Words of a polite reply (counting), and of a reply that makes a pair.
POLITE_REPLY = "お客様|申し訳|ご返金|新品|発送"
PAIR_REPLY = "お客様|申し訳|ご返金|新品|発送|交換|お願い"

# Phrases counted in assistant messages.
PHRASES = [
    "お客様", "この度は", "誠に申し訳ございません", "申し訳ございません", "何卒よろしくお願い申し上げます", "何卒よろしくお願い致します", "恐れ入りますが", "お世話になっております",
    "ご確認ください", "お手数ですが", "新品", "返金", "発送", "交換", "弊社は中古品を販売しておりません", "ご返信ありがとうございます", "お問い合わせいただき", "承知いたしました",
]

# Project name of conversations without one, and of curated feedback.
NO_PROJECT = "未分类"
FEEDBACK_PROJECT = "人工反馈"

# A line with any of these states a parameter.
PARAM_HINTS = [
    "長", "長さ", "コード", "線", "線長", "寸法", "サイズ", "定格", "消費電力", "容量", "重量", "質量", "出力", "電圧", "线长", "电源线", "电线",
    "尺寸", "功率", "电压", "容量", "重量", "配件", "付属品", "セット内容", "電源側", "本体側", "充電ケーブル",
]

# Fact keywords by group.
FACT_KEYWORDS = {
    "充电时间": ["充電時間", "充电时间"],
    "充电指示": ["充電中", "満充電", "充电中", "充满", "点灯", "点滅"],
    "电池": ["電池容量", "電池種類", "バッテリー", "电池容量"],
    "尺寸重量": ["外形寸法", "質量", "重量", "サイズ", "尺寸"],
    "连接": ["ペアリング", "接続方法", "登録方法", "长按", "長押し", "连接方法"],
    "电源": ["定格電圧", "定格出力", "定格消費電力", "输入", "入力"],
    "线长": ["電源コード長", "電源側コード長", "本体側コード長", "コード長", "線長", "充電ケーブル", "电源线", "线长"],
    "温度": ["温度", "温度設定", "予熱", "预热"],
    "容量": ["タンク容量", "容量", "水箱"],
    "功能按键": ["TURBO", "連射", "连射", "マクロ", "宏", "M1", "M2", "振動", "震动"],
}

# What makes a page a specification page, and what a value looks like.
SPEC_WORDS = ["仕様", "規格", "spec", "制品仕様", "产品规格", "规格"]
SPEC_LABELS = [
    "消費電力", "定格消費電力", "定格電圧", "定格周波数", "定格", "製品寸法", "寸法", "コード長", "電源コード", "容量", "重量", "材質", "出力", "電圧",
    "タイマー", "温度調節", "消費电力", "功率", "电压", "尺寸", "容量", "重量", "线长",
]
SPEC_TABLE_WORDS = ["製品型番", "品番", "品名"]
SPEC_FILE_WORDS = ["规格", "仕様"]
VALUE_PATTERN = r"(?U)\d+\s*(W|V|Hz|cm|CM|m|kg|g|ml|本|時間|H)\b"

# Sheet header rules - prefixes of a header cell and the field they name.
HEADER_DATE = ["日期", "更新月份"]
HEADER_COLUMNS = ["模板", "对应方法", "担当", "问题"]
COLUMN_RULES = [
    ("date", ["日期", "更新月份"]),
    ("category", ["故障类型", "类型"]),
    ("owner", ["担当", "负责人"]),
    ("question", ["问题"]),
    ("answer", ["对应方法", "处理方法", "对策"]),
    ("template", ["模板", "回复", "文案"]),
    ("asin", ["ASIN"]),
    ("product", ["品名", "商品"]),
]

# Product aliases by lowercase key.
ALIASES = {
    "switch手柄": ["switch手柄", "sw手柄", "switch", "sw", "06手柄", "05手柄", "03手柄", "pro手柄"],
    "ps4手柄": ["ps4", "p4", "p4手柄", "ps4手柄", "playstation"],
    "ds-100熨斗": ["机械熨斗", "ds-100", "ds100", "熨斗"],
    "ds-700熨斗": ["ds-700", "ds700", "熨斗"],
    "lm-026熨斗": ["lm-026", "lm026", "熨斗", "蒸汽熨斗"],
}

# The starting synonym table, terms with their expansions.
SYNONYMS = [
    ("包装内容", ["セット内容", "同梱物", "同梱", "内容品", "パッケージ内容", "付属品"]),
    ("包装清单", ["セット内容", "同梱物", "内容品", "パッケージ内容"]),
    ("箱子里有什么", ["セット内容", "同梱物", "内容品", "付属品"]),
    ("配件", ["付属品", "同梱", "同梱物", "附属", "付属", "パーツ", "補修用キット", "セット内容"]),
    ("附件", ["付属品", "同梱", "附属", "付属", "パーツ", "セット内容"]),
    ("零件", ["付属品", "パーツ", "部品"]),
    ("线长", ["線長", "コード長", "ケーブル長", "電源コード長", "電源側コード長", "本体側コード長"]),
    ("线长度", ["線長", "コード長", "ケーブル長", "電源コード長", "電源側コード長", "本体側コード長"]),
    ("电线多长", ["線長", "コード長", "ケーブル長", "電源コード長", "電源側コード長", "本体側コード長"]),
    ("充电", ["充電", "チャージ"]),
    ("不加热", ["无法加热", "加熱しない", "温まらない", "発熱しない", "加熱不能"]),
    ("无法加热", ["加熱しない", "温まらない", "発熱しない", "加熱不能"]),
    ("不能充电", ["无法充电", "充電できない", "充電不能"]),
    ("不充电", ["无法充电", "充電できない"]),
    ("充不上电", ["无法充电", "充電できない"]),
    ("断电", ["自动关机", "自动停止", "停止工作", "过载", "過負荷", "電源が切れる"]),
    ("自动关机", ["自动停止", "停止工作", "过载", "過負荷"]),
    ("不出激光", ["不出光", "不发光", "フラッシュが出ない", "照射できない", "発光しない"]),
    ("不出光", ["フラッシュが出ない", "照射できない", "発光しない"]),
    ("不出泡沫", ["不出泡", "出泡异常", "泡が出ない"]),
    ("出泡异常", ["不出泡", "泡が出ない"]),
    ("不喷", ["不出泡沫", "不出泡", "噴霧しない"]),
    ("漏水", ["水漏れ", "漏れ"]),
    ("噪音", ["异音", "異音", "音が大きい"]),
    ("声音大", ["噪音", "异音", "異音"]),
    ("吸力小", ["吸力弱", "灰尘吸不进", "吸引力が弱い"]),
    ("吸不进", ["灰尘吸不进", "吸引力が弱い", "吸い込まない"]),
    ("堵塞", ["詰まり", "堵"]),
    ("不启动", ["无法启动", "启动异常", "起動しない"]),
    ("启动不了", ["无法启动", "启动异常", "起動しない"]),
    ("不转", ["不工作", "不运转", "无法启动", "起動しない", "動かない", "稼働できない", "不转动"]),
    ("不转动", ["不工作", "不运转", "无法启动", "起動しない", "動かない", "稼働できない"]),
    ("不运转", ["不工作", "无法启动", "起動しない", "動かない", "稼働できない"]),
    ("不工作", ["无法启动", "不运转", "起動しない", "動かない", "稼働できない"]),
    ("不动", ["不工作", "不运转", "无法启动", "起動しない", "動かない", "稼働できない"]),
    ("不能开机", ["无法启动", "启动异常", "起動しない", "電源が入らない"]),
    ("不开机", ["无法启动", "启动异常", "起動しない", "電源が入らない"]),
    ("不出雾", ["噴霧しない", "雾化"]),
    ("电源线", ["電源コード", "電源側コード", "コード"]),
    ("电源线长度", ["電源コード長", "電源側コード長", "本体側コード長", "電源側", "本体側"]),
    ("充电线", ["充電ケーブル", "充電コード", "USBケーブル"]),
    ("尺寸", ["寸法", "サイズ", "外形寸法"]),
    ("功率", ["消費電力", "定格出力", "定格消費電力"]),
    ("消费电力", ["消費電力", "定格消費電力"]),
    ("消費電力", ["消费电力", "功率"]),
    ("电压", ["定格電圧", "電圧", "入力電圧"]),
    ("容量", ["容量", "タンク容量"]),
    ("重量", ["重量", "質量"]),
]


def synonym_rows() -> list[tuple[str, str, int]]:
    """(term, expansion, ord) rows of the starting table."""
    pairs = [(term, word) for term, words in SYNONYMS for word in words]
    return [(term, word, i) for i, (term, word) in enumerate(pairs)]


def alias_rows() -> list[tuple[str, str, int]]:
    """(key, alias, ord) rows."""
    pairs = [(key, alias) for key, aliases in ALIASES.items() for alias in aliases]
    return [(key, alias, i) for i, (key, alias) in enumerate(pairs)]
