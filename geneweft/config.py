"""Constants and tunable settings. Every threshold of the library lives here."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: kinetic baselines per host, units and search words -----------------

HOST_BASELINES = {
    "Escherichia coli": {
        "transcription_rate": 8.33,
        "translation_rate": 0.033,
        "mrna_deg_rate": 0.00167,
        "protein_deg_rate": 0.00083,
        "kd": 1000.0,
        "n": 2.0,
        "total_rnap": 50.0,
        "total_ribosomes": 500.0,
    },
    "Bacillus subtilis": {
        "transcription_rate": 6.5,
        "translation_rate": 0.02,
        "mrna_deg_rate": 0.002,
        "protein_deg_rate": 0.0005,
        "kd": 1200.0,
        "n": 2.0,
        "total_rnap": 40.0,
        "total_ribosomes": 400.0,
    },
    "Saccharomyces cerevisiae": {
        "transcription_rate": 0.5,
        "translation_rate": 0.005,
        "mrna_deg_rate": 0.0005,
        "protein_deg_rate": 0.0001,
        "kd": 500.0,
        "n": 2.0,
        "total_rnap": 150.0,
        "total_ribosomes": 2000.0,
    },
}
DEFAULT_HOST = "Escherichia coli"
KM_DEFAULTS = {"km_rnap": 100.0, "km_ribo": 500.0}

TIME_UNITS = {
    "s": 1.0, "sec": 1.0, "second": 1.0, "seconds": 1.0,
    "min": 60.0, "minute": 60.0, "minutes": 60.0,
    "h": 3600.0, "hr": 3600.0, "hour": 3600.0, "hours": 3600.0,
}
CONCENTRATION_UNITS = {"nm": 1.0, "um": 1000.0, "mm": 1000000.0, "m": 1000000000.0, "pm": 0.001}

PARAGRAPH_WORDS = ("kd", "constant", "rate", "half-life", "halflife", "nm", "um", "mm", "min", "sec", "hour")
COMPONENT_WORDS = (
    "感測器", "sensor", "輸入", "input", "邏輯閘", "gate", "nor", "not",
    "output device", "output_device", "output_devices", "輸出元件", "輸出",
)
DEATH_WORDS = ("lysis", "裂解", "細胞死亡", "suicide", "cell death", "死亡", "凋亡", "death")
TOGGLE_WORDS = ("toggle", "memory", "bistable", "雙穩態", "記憶")
OSCILLATOR_WORDS = ("oscillat", "repressilator", "振盪")
LOGIC_TOKENS = ("and(", "or(", "not(", "nor(", "nand(", "assign ")

PENALTY_TEXT = {
    "repeat": "Penalty triggered: Repeat sequence '%s' found. (C_Plausibility reduced)",
    "complexity": "Penalty triggered: High network complexity. (C_Plausibility reduced)",
    "plausibility": "Penalty triggered: Topology/Component complexity or repetition. (C_Plausibility reduced)",
    "functional": "Penalty triggered: Sub-optimal Fold Change (%.2f) or Logic Compliance. (Score_Functional reduced)",
    "kinetic": "Penalty triggered: High Coefficient of Variation (CV = %.4f) under noise. (R_Kinetic reduced)",
    "burden": "Penalty triggered: High metabolic toxicity. Max burden (%.1f nM) approaches limit. (P_Burden reduced)",
    "temporal": "Penalty triggered: Slow signal propagation. Average rise time (%.1f s). (Score_Temporal reduced)",
}

COMPONENT_TEXT = {
    "unnamed": "（未命名）",
    "unknown_collection": "（未知 collection）",
    "unspecified_host": "未指定",
    "name": "元件名稱：%s。",
    "type": "類型：%s（%s）。",
    "function": "功能描述：%s適用宿主/生物體：%s。",
    "note": "附註：%s。",
    "response_equation": "反應函數：equation=%s；parameters=%s。",
    "response_other": "反應函數：%s。",
    "toxicity": "毒性：%s。",
    "burden": "代謝負擔：%s。",
    "failed": "元件名稱：%s。類型：%s。功能描述：此元件解析失敗，以下保留原始欄位以供除錯：%s",
    "role_gate": "邏輯閘（gate）",
    "role_output": "輸出元件（output device）",
    "role_sensor": "感測器／輸入（sensor/input）",
    "role_component": "元件（component）",
    "gate": "這是一個邏輯閘。",
    "gate_of": "這是一個 %s 邏輯閘。",
    "output": "這是一個輸出元件。",
    "output_of": "這是一個輸出元件，輸出類型為 %s。",
    "sensor": "這是一個感測器／輸入元件。",
    "sensor_of": "這是一個感測器／輸入元件，感測訊號為 %s。",
    "component": "這是一個 UCF 元件。",
}

GUARD_TEXT = {"blank": "Empty Verilog code provided.", "invalid": "Invalid Verilog: "}

# Feedback of the verdicts; %s takes a state, a number of two decimals or a threshold.
FEEDBACK_TEXT = {
    "empty": "【ODE 驗證失敗】無完整的測試結果或目標真值表。",
    "no_target": "【ODE 驗證失敗】找無目標輸出節點 '%s' 的資料。",
    "pass": "【ODE 驗證成功】符合預期邏輯行為且 Fold Change 達標。",
    "leak": "在輸入條件 %s 時，預期輸出為 OFF，但輸出元件的洩漏表現量達 %s a.u. (高於 OFF 閾值 %s)。",
    "logic": "在輸入條件 %s 時，預期輸出為 ON，但模擬穩態值僅為 %s a.u. (低於 ON 閾值 %s)。電路拓樸可能存在邏輯短路或反轉。",
    "prefix": "【ODE 驗證失敗】",
    "fold": " 目前的 Fold Change 僅為 %s 倍。",
    "leak_advice": "請 Builder 考慮引入更強的阻遏蛋白、增加降解標籤 (Degradation Tag)、或是更換 weaker promoter 降低 Leakage。",
    "logic_advice": "請重新檢查邏輯閘的級聯關係或增加訊號放大。",
    "weak_fold": "【ODE 驗證失敗】系統未能達到標準 Fold Change (目前為 %s)。",
    "sample": "樣本 %s: %s",
    "sample_burden": "UNINTENDED_BURDEN (Max burden %s > %s)",
}
MC_TEXT = {
    "no samples": "未提供任何模擬數據。",
    "toxic": "【ODE 驗證失敗】在理想無噪音環境下，您的設計未能通過毒性檢測。",
    "quiet pass": "【ODE 快速驗證】在理想無噪音環境下，您的設計已通過邏輯與毒性檢測。%s",
    "logic": "【ODE 驗證失敗】在理想無噪音環境下，您的設計未能通過邏輯檢測。",
    "mostly toxic": "【ODE 驗證失敗】(UNINTENDED_BURDEN) 在 %s 組變異參數中，有 %s 組因蛋白質總代謝負荷（>%s）引發細胞毒性崩潰。請降低 promoter 強度或加入負回饋。",
    "pass": "【ODE 壓力測試】在 %s%% 的系統噪音下，經過 %s 次模擬，電路的穩健度為 %s%%（大於或等於及格門檻 %s%%），驗證通過。%s",
    "not robust": "【ODE 驗證警告】您的設計在壓力測試下未達標。在 %s%% 噪音與 %s 次模擬中，穩健度僅為 %s%% (未能達到及格門檻 %s%%)。建議重點重構電路拓樸或更換啟動子。",
    "death": " (EXPECTED_DEATH)",
}

DECISION_TEXT = {
    "decision": "REVISE",
    "error_type": "NONE",
    "feedback": "No feedback provided.",
    "warning": "Warning: Valid PASS but invalid selected_index %s. ",
    "route": "[ROUTE: %s] [ERROR: %s] ",
    "ucf": "[UCF: %s] ",
}

CONTEXT_TEXT = {
    "header": "\n--- Search results for %s in %s ---\n",
    "failure": "\nFailed to scrape %s: %s",
    "none": "No specific database context could be retrieved.",
}

TRANSCRIPT_TEXT = {
    "session": "════════ 在線迭代對抗紀錄 %d ════════",
    "round": "\n── 迭代輪次 %d ──",
    "builder": "\n【合成生物學系統工程師】\n",
    "critic": "\n\n【嚴苛的生物安全與可行性審查員】\n",
}

CARRY_TEXT = {"user": "\n\n【使用者追加條件】\n", "oracle": "\n\n【Automated Oracle 反饋】\n"}

CANDIDATE_TEXT = {
    "index": "=== 候選方案 Index: %d ===\n",
    "topology": "【拓樸結構】\n%s\n\n",
    "result": "【ODE 模擬分數/結果】\n%s\n\n",
}

DIALOGUE_TEXT = {"builder": "【Builder (Round %d)】\n%s", "critic": "【Critic (Round %d)】\n%s"}

# --- fixed values end ------------------------------------------------------------------


@dataclass(frozen=True)
class VerdictConfig:
    """Truth-table and Monte Carlo verdicts, in nM."""

    on: float = 1000.0
    off: float = 100.0
    toxicity: float = 50000.0
    pass_threshold: float = 90.0
    zero_off: str = "fail"  # fold change without any leakage: "fail" gives 0, "inf" gives infinity


@dataclass(frozen=True)
class FunctionalConfig:
    on: float = 1000.0
    off: float = 100.0
    k_ideal: float = 50.0
    n_hill: float = 2.0
    w_fc: float = 0.6
    w_margin: float = 0.4


@dataclass(frozen=True)
class KineticConfig:
    on: float = 1000.0
    limit_soft: float = 45000.0
    k_burden: float = 0.001
    k_cv: float = 2.0
    fc_ideal: float = 50.0
    t_target: float = 7200.0


@dataclass(frozen=True)
class ViabilityConfig:
    functional: FunctionalConfig = FunctionalConfig()
    kinetic: KineticConfig = KineticConfig()
    excellent: float = 80.0
    passing: float = 60.0


@dataclass(frozen=True)
class RateConfig:
    """Literal defaults of the rate table, used when neither the per-species nor the shared key exists."""

    plasmid: float = 20.0
    total_rnap: float = 50.0
    total_ribosomes: float = 500.0
    kd: float = 1000.0
    n: float = 2.0
    kd_inducer: float = 5000.0
    n_inducer: float = 2.0
    km_rnap: float = 100.0
    km_ribo: float = 500.0
    leakage: float = 0.005
    transcription_rate: float = 8.33
    translation_rate: float = 0.033
    mrna_deg_rate: float = 0.00167
    protein_deg_rate: float = 0.00083
