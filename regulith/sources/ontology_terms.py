"""Default ontology vocabulary, one table per level: code -> keywords in matching order.

Every ontology operator takes these tables as a parameter, so a site can pass its own.
"""

# Keywords per code.
JURISDICTIONS = {
    "guangdong": ["guangdong", "gd", "pearl river delta", "广东", "粤", "珠三角", "广东省"],
    "shandong": ["shandong", "sd", "bohai bay", "山东", "鲁", "山东省", "渤海湾"],
    "inner_mongolia": ["inner mongolia", "mongolia", "im", "内蒙古", "蒙", "内蒙", "内蒙古自治区"],
    "sichuan": ["sichuan", "sc", "chengdu", "四川", "川", "四川省", "成都"],
}
MARKETS = {
    "grid_connection": ["grid connection", "interconnection", "grid access", "电网接入", "并网", "接入", "电网连接", "接入系统"],
    "market_rules": ["market rules", "trading", "electricity market", "市场规则", "交易规则", "电力市场", "市场交易", "交易"],
    "dispatch_ops": ["dispatch", "operations", "system operations", "调度", "运行", "调度运行", "系统运行", "电力调度"],
    "renewable_policy": ["renewable", "clean energy", "green energy", "可再生能源", "清洁能源", "绿色能源", "新能源", "可再生"],
    "storage_policy": ["storage", "battery", "energy storage", "储能", "电池", "储能系统", "蓄能", "储电"],
    "coal_flexibility": ["coal flexibility", "thermal flexibility", "煤电灵活性", "火电灵活性", "灵活性改造", "煤电", "火电"],
}
ASSETS = {
    "wind": ["wind", "wind power", "wind farm", "turbine", "风电", "风力发电", "风场", "风机", "风力", "风能"],
    "solar": ["solar", "photovoltaic", "pv", "solar farm", "太阳能", "光伏", "太阳能发电", "光伏发电", "太阳能电站"],
    "bess": ["battery", "storage", "bess", "energy storage", "储能", "电池", "储能系统", "电池储能", "蓄电池"],
    "coal": ["coal", "thermal", "coal power", "fossil", "煤电", "火电", "燃煤", "煤炭", "火力发电"],
    "general": ["general", "all", "multiple", "various", "通用", "所有", "各类", "多种", "一般"],
}
LIFECYCLES = {
    "planning": ["planning", "feasibility", "development", "规划", "可行性", "前期", "筹备", "计划"],
    "development": ["development", "permitting", "approval", "开发", "审批", "许可", "核准", "备案"],
    "construction": ["construction", "installation", "building", "建设", "施工", "安装", "建造", "工程"],
    "commissioning": ["commissioning", "testing", "startup", "调试", "试运行", "验收", "测试", "启动"],
    "operation": ["operation", "performance", "generation", "运行", "运营", "发电", "生产", "操作"],
    "maintenance": ["maintenance", "repair", "service", "维护", "维修", "保养", "检修", "服务"],
}
REQUIREMENTS = {
    "technical": ["technical", "specification", "standard", "requirement", "技术", "技术要求", "规范", "标准", "参数"],
    "procedural": ["procedure", "process", "administrative", "approval", "程序", "流程", "手续", "审批", "办理"],
    "financial": ["financial", "economic", "cost", "payment", "财务", "经济", "费用", "成本", "资金"],
    "safety": ["safety", "protection", "security", "安全", "保护", "防护", "安全性", "安全要求"],
    "environmental": ["environmental", "environment", "ecological", "环境", "环保", "生态", "环境保护", "环境要求"],
    "reporting": ["reporting", "data", "information", "disclosure", "报告", "数据", "信息", "披露", "上报"],
}
PARAMETERS = {
    "capacity": ["capacity", "power", "mw", "kw", "容量", "功率", "装机", "兆瓦", "千瓦", "MW", "KW"],
    "voltage": ["voltage", "kv", "volt", "电压", "千伏", "伏特", "KV", "电压等级"],
    "frequency": ["frequency", "hz", "hertz", "频率", "赫兹", "Hz", "系统频率"],
    "efficiency": ["efficiency", "performance", "conversion", "效率", "转换效率", "性能", "能效"],
    "timeline": ["timeline", "time", "duration", "deadline", "时间", "期限", "工期", "时限", "截止"],
}

LEVELS = {
    "jurisdictions": JURISDICTIONS,
    "markets": MARKETS,
    "assets": ASSETS,
    "lifecycles": LIFECYCLES,
    "requirements": REQUIREMENTS,
    "parameters": PARAMETERS,
}

# Patterns counted when no jurisdiction keyword occurs.
JURISDICTION_PATTERNS = {
    "guangdong": "广东省?|粤|珠三角|gzpec|guangdong",
    "shandong": "山东省?|鲁|shandong|渤海湾",
    "inner_mongolia": "内蒙古|蒙|inner.?mongolia",
    "sichuan": "四川省?|川|sichuan|成都",
}
# Market code cascade for texts without any entity.
MARKET_CUES = [
    ("grid_connection", ["并网", "接入", "grid", "connection"]),
    ("market_rules", ["市场", "交易", "market", "trading"]),
    ("dispatch_ops", ["调度", "运行", "dispatch", "operation"]),
    ("renewable_policy", ["可再生", "新能源", "renewable"]),
    ("storage_policy", ["储能", "storage", "battery"]),
    ("coal_flexibility", ["煤电", "火电", "coal", "thermal"]),
]
