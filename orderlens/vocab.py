"""Fixed vocabulary: field names, aliases, status words and token sets.

Everything in this module is a fixed value that decides results; the logic that
uses it lives in :mod:`orderlens.functions` and :mod:`orderlens.operators`.
"""

from __future__ import annotations

# --- Fixed values: standard order-line fields, in tie-breaking order ---------
STANDARD_FIELDS = (
    "order_id",
    "user_id",
    "product_id",
    "product_name",
    "order_date",
    "quantity",
    "unit_price",
    "total_amount",
    "payment_method",
    "status",
    "city",
    "category",
    "user_level",
)


# --- Fixed values: header aliases per standard field -------------------------
FIELD_ALIASES = {
    "order_id": (
        "order_id", "orderid", "订单id", "订单号", "订单编号", "订单号码", "订单编码",
        "交易订单号", "商家订单号", "主订单号", "子订单号", "业务订单号", "原订单号",
        "外部订单号", "平台订单号", "流水号", "交易号", "订单流水号",
    ),
    "user_id": (
        "user_id", "userid", "customer_id", "customerid", "用户id", "客户id", "买家id",
        "买家uid", "用户uid", "会员id", "会员编号", "客户编号", "用户编号", "买家编号",
        "消费者id", "客户账号", "买家账号", "会员账号", "用户账号",
    ),
    "product_id": (
        "product_id", "productid", "sku_id", "skuid", "spu_id", "spuid", "商品id",
        "商品编号", "商品编码", "货品id", "货品编号", "货品编码", "sku编码", "sku编号",
        "spu编码", "spu编号", "商家编码", "商品款号", "商品货号", "货号",
    ),
    "product_name": (
        "product_name", "productname", "商品名称", "商品名", "产品名称", "产品名", "货品名称",
        "货品名", "sku名称", "spu名称", "商品标题", "宝贝名称", "宝贝标题", "标题",
    ),
    "order_date": (
        "order_date", "orderdate", "order_time", "ordertime", "订单日期", "订单时间", "下单日期",
        "下单时间", "创建时间", "订单创建时间", "支付时间", "付款时间", "支付成功时间",
        "成交时间", "交易时间", "结算时间", "完成时间", "统计日期", "日期", "时间",
    ),
    "quantity": (
        "quantity", "qty", "商品数量", "购买数量", "下单数量", "成交数量", "支付件数", "成交件数",
        "销售数量", "销量", "件数", "数量", "商品件数", "sku数量",
    ),
    "unit_price": (
        "unit_price", "unitprice", "商品单价", "成交单价", "销售单价", "支付单价", "实付单价",
        "折后单价", "sku单价", "价格", "售价", "单价",
    ),
    "total_amount": (
        "total_amount", "totalamount", "gmv", "实付金额", "用户实付", "买家实付", "客户实付",
        "用户支付金额", "买家支付金额", "实际支付金额", "支付金额", "付款金额",
        "订单实付", "订单实收", "实收金额", "成交金额", "交易金额", "订单金额", "订单总额",
        "销售金额", "销售额", "商品金额", "结算金额", "应收金额", "收入金额", "营业收入",
        "含税金额", "折后金额", "总价", "总金额", "金额",
    ),
    "payment_method": (
        "payment_method", "paymentmethod", "支付方式", "付款方式", "支付渠道", "付款渠道",
        "支付类型", "付款类型", "支付工具",
    ),
    "status": (
        "status", "order_status", "orderstatus", "订单状态", "交易状态", "支付状态", "付款状态",
        "订单完成状态", "售后状态", "状态",
    ),
    "city": (
        "city", "城市", "所在城市", "收货城市", "用户城市", "客户城市", "地区", "区域",
        "收货地区", "省市", "城市名称",
    ),
    "category": (
        "category", "商品分类", "商品品类", "品类", "类目", "一级类目", "一级品类",
        "产品分类", "商品类目", "主营类目", "分类",
    ),
    "user_level": (
        "user_level", "userlevel", "用户等级", "客户等级", "会员等级", "会员级别", "用户级别",
        "会员层级", "客户层级", "用户分层",
    ),
}

# --- Fixed values: status words per normalised status, in matching order -----
STATUS_WORDS = {
    "completed": (
        "已完成", "完成", "订单完成", "交易完成", "交易成功", "支付成功", "付款成功", "已支付",
        "已付款", "已成交", "已收货", "确认收货", "已结算", "结算成功", "成功", "paid",
        "completed", "complete", "finished", "success", "succeeded", "settled", "received",
    ),
    "cancelled": (
        "已取消", "取消", "订单取消", "交易取消", "已关闭", "交易关闭", "订单关闭", "关闭",
        "cancelled", "canceled", "cancel", "closed",
    ),
    "refunded": (
        "退款", "已退款", "退款中", "退货退款", "退款成功", "全部退款", "部分退款",
        "售后退款", "refunded", "refund", "refunding", "partiallyrefunded",
    ),
    "pending": (
        "待支付", "待付款", "未支付", "未付款", "待处理", "处理中", "待确认", "待发货",
        "已发货", "运输中", "pending", "unpaid", "processing", "shipped",
    ),
    "failed": ("失败", "支付失败", "付款失败", "交易失败", "failed", "fail"),
}
STATUS_DOMAIN = ("completed", "cancelled", "refunded", "pending", "failed", "unknown")

# --- Fixed values: characters removed when a name is normalised --------------
# (?U) makes \s cover the ideographic space U+3000 as well.
NAME_NOISE = r"(?U)[\s_\-—/\\|（）()\[\]{}【】<>《》:：,.，。]+"

# --- Fixed values: matching scores -------------------------------------------
EXACT_SCORE = 100
ALIAS_IN_NAME_BASE = 70
NAME_IN_ALIAS_BASE = 45
SCORE_LENGTH_CAP = 20
ACCEPT_SCORE = 50
HEADER_FIELD_POINTS = 30
HEADER_EXACT_POINTS = 8
HEADER_CELL_CAP = 20
HEADER_SEARCH_ROWS = 30
DELIMITER_TYPICAL_COLUMNS = 12
DELIMITER_ROW_CAP = 10_000
DELIMITERS = (",", "\t", ";", "|")
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "gbk", "big5")

# --- Fixed values: token sets (compared after trim and lower unless noted) ---
BLANK = ("", "nan", "none", "null", "unknown", "未知")
BLANK_CATEGORY = BLANK + ("未分类",)
BAD_NUMBER = ("", "nan", "none", "null", "n/a", "na", "--", "-")
BAD_USER = ("", "unknown", "nan", "none", "null", "未知")  # lower, not trimmed
BLANK_AFTERSALE = ("", "nan", "None")  # trimmed, case-sensitive
# Cell texts that a delimited file reader takes as missing.
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- Fixed values: patterns ---------------------------------------------------
NUMERIC_CELL = r"^[¥￥$€£]?\s*\(?[-+]?\d[\d,，]*(?:\.\d+)?\)?\s*[元件万千亿]?$"
CATEGORY_SEPARATOR = r"[/＞>→|]"
NUMBER_UNITS = (("亿", 1e8), ("万", 1e4), ("千", 1e3))

# --- Fixed values: default labels ---------------------------------------------
UNKNOWN_LABEL = "未知"
UNCATEGORISED = "未分类"
UNKNOWN_PRODUCT_LABEL = "未知商品"
NO_STATUS_LABEL = "未提供状态"
AFTERSALE_MARK = "售后"
AFTERSALE_DONE = "已完成"
UNNAMED_COLUMN = "未命名列_"
UNKNOWN_ID = "unknown"
UNKNOWN_PRODUCT_ID = "unknown_product"
GENERATED_ORDER_ID = "ROW%07d"
NO_USER_MESSAGE = "原数据缺乏用户维度，无法分析"
MISSING_TEXT = "—"
MONTH, DAY = "月", "日"

# --- Fixed values: limits of the standard reports ------------------------------
TOP_PRODUCTS = 10
TOP_USERS = 20
TOP_USER_CHART = 10
TOP_ORDERS = 10
HIGH_VALUE_FACTOR = 3
DAILY_MAX_DATES = 31
PREVIEW_ROWS = 10
MIN_QUANTITY_THRESHOLD = 10
DEFAULT_QUANTITY_THRESHOLD = 20
BLANK_RATIO_LIMIT = 0.9
VALID_AMOUNT_RATIO = 0.1

# --- Fixed values: display labels of result columns ----------------------------
DISPLAY_LABELS = {
    "trend": {"period": "时间", "orders": "订单数", "gmv": "销售额 GMV", "users": "用户数"},
    "status_distribution": {"status": "订单状态", "orders": "订单数", "pct": "占比"},
    "top_products": {
        "product_id": "商品ID", "product_name": "商品名称", "category": "品类",
        "total_qty": "销量", "revenue": "销售额",
    },
    "categories": {
        "category": "品类", "orders": "订单数", "gmv": "销售额 GMV", "qty": "销量",
    },
    "margin": {
        "category": "品类", "revenue": "销售额", "total_cost": "总成本",
        "gross_profit": "毛利", "gross_margin_pct": "毛利率",
    },
    "repurchase": {
        "user_level": "用户等级", "users": "用户数", "avg_orders": "平均订单数",
        "avg_spend": "平均消费金额", "repurchase_rate": "复购率",
    },
    "users": {
        "user_id": "用户ID", "user_level": "用户等级", "city": "城市",
        "order_count": "订单数", "total_spend": "累计消费金额",
    },
    "high_value_orders": {
        "order_id": "订单ID", "user_id": "用户ID", "order_date": "订单时间",
        "quantity": "数量", "total_amount": "订单金额", "status_norm": "标准状态",
        "is_anomaly": "是否异常",
    },
}
# Columns shown as money or as a percentage, per result.
DISPLAY_MONEY = {
    "trend": ("gmv",),
    "top_products": ("revenue",),
    "categories": ("gmv",),
    "margin": ("revenue", "total_cost", "gross_profit"),
    "repurchase": ("avg_spend",),
    "users": ("total_spend",),
    "high_value_orders": ("total_amount",),
}
DISPLAY_PERCENT = {
    "status_distribution": ("pct",),
    "margin": ("gross_margin_pct",),
    "repurchase": ("repurchase_rate",),
}

# --- Fixed values: names of missing business dimensions -------------------------
MISSING_DIMENSIONS = {
    "user": "user_id（用户维度）",
    "product": "product_id/product_name（商品维度）",
    "date": "order_date（时间维度）",
    "amount": "total_amount（金额维度）",
    "category": "category（品类维度）",
}
