"""Packaged state trackers: rules as data.

``_rule`` builds one rule from a tag prefix, tag regex, message text or regex and section; an integer value
means that capture group (tag groups count first).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.extract import group_count
from ..functions.predicates import all_of, message_contains, message_regex, section_is, tag_prefix, tag_regex
from ..operators.tracker import Rule
from .base import Tracker


class G(int):
    """A capture group."""


def _rule(name, set=None, clear=(), tag=None, tag_re=None, text=None, regex=None, section=None) -> Rule:
    conds = []
    if section:
        conds.append(section_is(section))
    if tag:
        conds.append(tag_prefix(tag))
    if tag_re:
        conds.append(tag_regex(tag_re))
    if text:
        conds.append(message_contains(text))
    if regex:
        conds.append(message_regex(regex))
    first = group_count(tag_re) if tag_re else 0
    group = lambda g: (F.regexp_extract("tag", tag_re, int(g)) if g <= first
                       else F.regexp_extract("message", regex, int(g) - first))
    values = {k: group(v) if isinstance(v, G) else v for k, v in (set or {}).items()}
    return Rule(name, all_of(*conds), values, tuple(clear))


G1, G2, G3, G4, G5, G6, G7 = (G(i) for i in range(1, 8))

# Fixed values from here on: rule names, tags, texts, patterns, states and defaults.


def app_lifecycle() -> list[Rule]:
    am = "ActivityManager"
    return [
        _rule("Activity Started", {"foreground_app": G1, "foreground_activity": G2, "crashed": False}, tag=am,
              regex=r"START.*cmp=([^\s/]+)/([^\s]+)"),
        _rule("App Crashed", {"last_crash": G1, "crashed": True}, tag=am, regex=r"Process ([^\s]+) \(pid \d+\) has died"),
        _rule("ANR Detected", {"last_crash": G1, "crashed": True}, tag=am, regex=r"ANR in ([^\s]+)"),
        _rule("App Resumed", {"foreground_app": G1, "foreground_activity": G2, "crashed": False}, tag=am,
              regex=r"Displayed ([^\s/]+)/([^\s:]+)"),
    ]


def battery_health() -> list[Rule]:
    ui, aod = "PowerUI", "AODBatteryManager"
    return [
        _rule("Health Update", {"health": G1}, tag=ui, regex=r"BATTERY_HEALTH_CHECK extraHealth=(\d+)"),
        _rule("Protect Mode On", {"protect_mode": True}, tag=aod, regex=r"saveBatteryData.*mBatteryProtectMode=true"),
        _rule("Protect Mode Off", {"protect_mode": False}, tag=aod, regex=r"saveBatteryData.*mBatteryProtectMode=false"),
        _rule("Charger Type Update", {"charger_type": G1}, tag=aod, regex=r"saveBatteryData.*mBatteryChargerType=([A-Z_]+)"),
        _rule("Swelling Mode (AOD)", {"swelling_mode": G1}, tag=aod, regex=r"saveBatteryData.*mBatterySwellingMode=([A-Z_]+)"),
        _rule("Swelling Normal (PowerUI)", {"swelling_mode": "NONE"}, tag=ui,
              regex=r"Battery swelling mode.*mBatterySwellingMode = 0\b"),
        _rule("Swelling Active (PowerUI)", {"swelling_mode": "SWELLING"}, tag=ui,
              regex=r"Battery swelling mode.*mBatterySwellingMode = ([1-9]\d*)"),
    ]


BATTERY_TAG = "BatteryService"
BATTERY_HEAD = r"Sending ACTION_BATTERY_CHANGED:.*level:(\d+)"
BATTERY_BODY = r".*voltage:(\d+).*temperature:(\d+).*current_avg:(-?\d+)"
BATTERY_TAIL = r".*charge_type:(\d+).*charger_type:(\d+).*hvc:(true|false)"
PLUGS = (("AC", "ac"), ("USB", "usb"), ("Wireless", "wireless"), ("Pogo", "pogo"))


def battery_state() -> list[Rule]:
    """A plug seen true means charging; the long form with charger data is tried for every plug first."""
    body = {"level": G1, "voltage": G2, "temperature": G3, "current_avg": G4}
    tail = {"charge_type": G5, "charger_type": G6, "hvc": G7}
    on = lambda plug: {"charging": True, "status": "charging", "plugged": plug}
    rules = [_rule(f"Charging via {n} (full)", {**body, **on(p), **tail}, tag=BATTERY_TAG,
                   regex=f"{BATTERY_HEAD}.*{p}:true{BATTERY_BODY}{BATTERY_TAIL}") for n, p in PLUGS]
    rules += [_rule(f"Charging via {n}", {**body, **on(p)}, tag=BATTERY_TAG, regex=f"{BATTERY_HEAD}.*{p}:true{BATTERY_BODY}")
              for n, p in PLUGS]
    for name, code, status, more in (("Discharging", 3, "discharging", {"plugged": "none"}),
                                     ("Not Charging", 4, "not_charging", {}), ("Battery Full", 5, "full", {})):
        rules.append(_rule(name, {**body, "charging": False, "status": status, **more}, tag=BATTERY_TAG,
                           regex=f"{BATTERY_HEAD}.*status:{code}{BATTERY_BODY}"))
    rules.append(_rule("Battery Level (ACTION_BATTERY_CHANGED fallback)", {"level": G1}, tag=BATTERY_TAG, regex=BATTERY_HEAD))
    rules.append(_rule("Battery Level (processValuesLocked)", {"level": G1}, tag=BATTERY_TAG,
                       regex=r"\[processValuesLocked\]batteryLevel:(\d+)"))
    return rules


VOICE, DATA = r"mVoiceRegState=\d+\(([^)]+)\)", r"mDataRegState=\d+\(([^)]+)\)"
TECH, OPERATOR = r"getRilDataRadioTechnology=\d+\(([^)]+)\)", r"mOperatorAlphaLong=([^,}\s][^,}]*)"
PHONE_TAG = r"PhoneStateTracker<(\d+)>"
RADIO_LOG = "RADIO LOG"


def cellular_registration() -> list[Rule]:
    full = {"voice_reg_state": 1, "data_reg_state": 2, "rat": 3, "operator": 4}
    shift = lambda d, by: {k: G(v + by) for k, v in d.items()}
    two = {k: full[k] for k in ("voice_reg_state", "data_reg_state")}
    simple = lambda name, field, code, value: _rule(
        name, {"slot": G1, field: value}, tag_re=PHONE_TAG,
        text=f"{'mVoiceRegState' if field == 'voice_reg_state' else 'mDataRegState'}={code}({value})")
    notifier = "notifyServiceStateForSubId:.*"
    return [
        _rule("Service State Changed (Full)", {"slot": G1, **shift(full, 1)}, tag_re=PHONE_TAG, regex=f"{VOICE}.*{DATA}.*{TECH}.*{OPERATOR}"),
        _rule("Service State Changed (Voice + Data)", {"slot": G1, **shift(two, 1)}, tag_re=PHONE_TAG,
              regex=f"onServiceStateChanged.*{VOICE}.*{DATA}"),
        _rule("Data RAT Changed", {"rat": G1}, tag="VolteServiceModule", regex=TECH),
        _rule("Operator Changed", {"operator": G1}, tag="VolteServiceModule", regex=r"mOperatorAlphaLong=([A-Za-z][^,}]+)"),
        simple("Voice In Service", "voice_reg_state", 0, "IN_SERVICE"),
        simple("Voice Out of Service", "voice_reg_state", 1, "OUT_OF_SERVICE"),
        simple("Data In Service", "data_reg_state", 0, "IN_SERVICE"),
        simple("Data Out of Service", "data_reg_state", 1, "OUT_OF_SERVICE"),
        _rule("SST Reject Cause", {"reject_code": G3, "operator": G4}, section=RADIO_LOG, tag="SST",
              regex=r"getStringForRejectCause.*isRadioOn:\s*(true|false).*mSS\.getState:\s*(\d+).*RejectCode:\s*(\d+).*plmn:\s*(.*)"),
        _rule("SST Combined Reg State", {"combined_reg_state": G1}, section=RADIO_LOG, tag="SST",
              regex=r"updateOperatorName.*combinedRegState:\s*(\d+)"),
        _rule("Radio Notifier State (Full)", shift(full, 0), section=RADIO_LOG, tag="DefaultPhoneNotifier",
              regex=f"{notifier}{VOICE}.*{DATA}.*{TECH}.*{OPERATOR}"),
        _rule("Radio Notifier State (Voice + Data)", shift(two, 0), section=RADIO_LOG, tag="DefaultPhoneNotifier",
              regex=f"{notifier}{VOICE}.*{DATA}"),
        _rule("NR State Change", {"nr_state": G2}, section=RADIO_LOG, tag="NetworkTypeController",
              regex=r"updateNrAdvancedState:\s*(\w+)\s*->\s*(\w+)"),
    ]


def memory_pressure() -> list[Rule]:
    tag = "ChimeraAggressivePolicyHandler"
    return [
        _rule("Memory Pressure Event", {"mem_available": G1, "mem_free_target": G2, "release_target": G3, "protected_lru_count": G4},
              tag=tag, regex=r"memAvailable:\s*(\d+).*memFreeTarget:\s*(\d+).*releaseTarget:(\d+).*protectedLruCount:\s*(\d+)"),
        _rule("LMKD Trigger", {"trigger_source": G1}, tag=tag, regex=r"executePolicy.*triggerSource:\s*(\S+)"),
    ]


def network_connectivity() -> list[Rule]:
    cs, off = "ConnectivityService", ("network_type",)
    return [
        _rule("Network Validated", {"connected": True, "validated": True, "network_type": G2}, tag=cs, regex=r"\[(\d+) (\w+)\] validation passed"),
        _rule("Network Validation Failed", {"connected": True, "validated": False, "network_type": G2}, tag=cs,
              regex=r"\[(\d+) (\w+)\] validation failed"),
        _rule("Network Capabilities Validated", {"validated": True}, tag=cs, regex=r"Update capabilities for net \d+ : .*\+VALIDATED"),
        _rule("Network Capabilities Lost Validation", {"validated": False}, tag=cs, regex=r"Update capabilities for net \d+ : .*-VALIDATED"),
        _rule("Network Exiting", {"connected": False, "validated": False}, off, tag=cs, regex=r"Update score for net \d+ : \+EXITING"),
        _rule("Network Exit Cancelled", {"connected": True}, tag=cs, regex=r"Update score for net \d+ : -EXITING"),
        _rule("Network Connected", {"connected": True, "network_type": G1}, tag=cs,
              regex=r"\[\d+ (\w+)\] EVENT_NETWORK_INFO_CHANGED, going from \w+ to CONNECTED"),
        _rule("Network Disconnected", {"connected": False}, off, tag=cs,
              regex=r"\[\d+ (\w+)\] EVENT_NETWORK_INFO_CHANGED, going from \w+ to DISCONNECTED"),
        _rule("Network Connected (Legacy)", {"connected": True, "network_type": G1}, tag=cs, regex=r"type: (\w+).*state: CONNECTED/CONNECTED"),
        _rule("Network Disconnected (Legacy)", {"connected": False}, off, tag=cs, regex=r"type: (\w+).*state: DISCONNECTED/DISCONNECTED"),
    ]


WPA, P2P_SERVICE, TETHER = "wpa_supplicant", "WifiP2pService", "Tethering"
MAC = "([0-9a-fA-F:]{17})"
P2P_IF = r"p2p-wlan\d+-\d+"
PEER_FIELDS = ("role", "peer_device", "peer_mac", "operating_freq")


def p2p_group_formation() -> list[Rule]:
    st = lambda s, **more: {"formation_state": s, **more}
    won = lambda role: _rule(f"GO Neg Success - Local is {'GO' if role == 'GO' else 'Client'}",
                             st("provisioning", role=role, operating_freq=G1, peer_mac=G2, go_neg_status="success"), tag=WPA,
                             regex=rf"P2P-GO-NEG-SUCCESS role={role} freq=(\d+).*peer_dev={MAC}")
    return [
        _rule("P2P Search Started", st("searching", failure_reason="none", race_detected=False), tag=WPA, text="State IDLE -> SEARCH"),
        _rule("P2P Device Found", st("device_found", peer_device=G1), tag=P2P_SERVICE, regex=r"P2P_DEVICE_FOUND_EVENT.*Device:\s+(\S+)"),
        _rule("GO Negotiation Started", st("go_negotiation", peer_mac=G1), tag=WPA, regex=f"GO Negotiation with {MAC}$"),
        _rule("GO Negotiation Race Detected", {"race_detected": True}, tag=WPA, text="Was not expecting GO Negotiation Response"),
        won("GO"), won("client"),
        _rule("GO Neg Failed", st("failed", go_neg_status="failed", failure_reason="go_negotiation_failed"), tag=P2P_SERVICE,
              text="P2P_GO_NEGOTIATION_FAILURE_EVENT"),
        _rule("Group Interface Created", {"group_interface": G1}, tag=WPA, regex=f"Initializing interface '({P2P_IF})'"),
        _rule("GO Beaconing (SSID)", {"ssid": G1}, tag=WPA, regex=r"hwaddr.*ssid \"(DIRECT-[^\"]+)\""),
        _rule("GO AP Setup Complete", st("awaiting_client"), tag=WPA, regex=r"hostapd_setup_bss.*p2p-wlan"),
        _rule("Client Association Received", st("authenticating", peer_mac=G1), tag=WPA,
              regex=f"hostapd_logger: STA {MAC}.*start authentication"),
        _rule("WPS Provisioning Started", st("wps_provisioning"), tag=WPA, text="WPS: Starting WPS"),
        _rule("P2P Group Started", st("formed", failure_reason="none"), tag=P2P_SERVICE, text="P2P_GROUP_STARTED_EVENT"),
        _rule("Tethering Active", st("formed", group_interface=G1), tag=TETHER, regex=f"adding IpServer for: ({P2P_IF})"),
        _rule("Group Removed", st("idle"), (*PEER_FIELDS, "group_interface", "ssid"), tag=P2P_SERVICE, text="P2P_GROUP_REMOVED_EVENT"),
        _rule("Tethering Removed", st("teardown"), tag=TETHER, regex=r"removing IpServer for: p2p-wlan"),
        _rule("Formation Timeout (Interface Removed Without Group)", st("failed", failure_reason="formation_timeout"), tag=WPA,
              regex=f"Remove interface ({P2P_IF}) from radio"),
        _rule("P2P Disabled", st("idle"), (*PEER_FIELDS, "failure_reason", "group_interface", "ssid", "race_detected"),
              tag=P2P_SERVICE, text="DISABLE_P2P"),
    ]


EAP_STEPS = (
    ("EAP Identity", "IDENTITY", {"wps_state": "eap_identity"}), ("EAP Method Selected", "METHOD", {}),
    ("EAP Integrity Check", "INTEGRITY_CHECK", {}), ("EAP Success", "SUCCESS", {}),
    ("EAP Failure", "FAILURE", {"wps_state": "failed", "failure_reason": "eap_failure"}),
)


def p2p_wps_provisioning() -> list[Rule]:
    say = lambda name, text, state, **more: _rule(name, {"wps_state": state, **more}, tag=WPA, text=text)
    rules = [_rule("Client Associated", {"wps_state": "authenticating", "peer_mac": G1, "failure_reason": "none"}, tag=WPA,
                   regex=f"hostapd_logger: STA {MAC}.*start authentication")]
    rules += [_rule(name, {**more, "eap_state": step}, tag=WPA, text=f"EAP entering state {step}") for name, step, more in EAP_STEPS]
    rules.append(say("WPS Started", "WPS: Starting WPS", "wps_started"))
    # Messages M1 to M8: odd ones are sent, even ones received.
    for i in range(1, 9):
        verb, past = ("Sending", "Sent") if i % 2 else ("Received", "Received")
        rules.append(say(f"WPS M{i} {past}", f"WPS: {verb} M{i}", f"m{i}_{past.lower()}"))
    rules += [
        say("WPS Success", "WPS: Enrollee: Learned new AP credentials", "wps_complete"),
        say("WPS Registration Success (GO side)", "WPS: Registration protocol completed successfully", "wps_complete"),
        say("WPS Timeout", "WPS: PBC session overlap", "failed", failure_reason="pbc_overlap"),
        _rule("WPS Failed", {"wps_state": "failed", "failure_reason": "wps_failure"}, tag=WPA, regex=r"WPS:.*[Ff]ail"),
        say("4-Way HS Message 1", "WPA: RX message 1 of 4-Way Handshake", "fourway_hs"),
        say("4-Way HS Message 3", "WPA: RX message 3 of 4-Way Handshake", "fourway_hs_msg3"),
        say("4-Way HS Complete", "WPA: Key negotiation completed", "connected", failure_reason="none"),
        say("4-Way HS Timeout", "EAPOL-Key timeout", "failed", failure_reason="fourway_hs_timeout"),
        say("Group Key HS Complete", "WPA: Group rekeying completed", "connected"),
        _rule("Client Deauthenticated", {"wps_state": "deauthenticated", "peer_mac": G1}, tag=WPA, regex=f"hostapd_logger: STA {MAC}.*deauth"),
        _rule("Interface Removed", {"wps_state": "idle"}, ("peer_mac", "eap_state", "group_interface", "failure_reason"), tag=WPA,
              regex=f"Remove interface ({P2P_IF}) from radio"),
    ]
    return rules


def airplane_mode() -> list[Rule]:
    tag, flag, sim = "MobileSignalController", "(true|false)", r"simCard=(\w+)"
    rule = lambda name, set, **match: _rule(name, set, tag_re=tag, **match)
    return [
        rule("Airplane On, Data Off", {"airplane_mode": True, "data_connected": G1, "emergency_only": G2, "sim_card_state": G3},
             regex=f"airplaneMode=true.*dataConnected={flag}.*emergencyOnly={flag}.*{sim}"),
        rule("Airplane Off, Data Connected", {"airplane_mode": False, "data_connected": True, "emergency_only": G1, "sim_card_state": G2},
             regex=f"airplaneMode=false.*dataConnected=true.*emergencyOnly={flag}.*{sim}"),
        rule("Airplane Off, Data Disconnected", {"airplane_mode": False, "data_connected": False, "emergency_only": G1, "sim_card_state": G2},
             regex=f"airplaneMode=false.*dataConnected=false.*emergencyOnly={flag}.*{sim}"),
        rule("Airplane On + Emergency (partial)", {"airplane_mode": True, "emergency_only": G1}, regex=f"airplaneMode=true.*emergencyOnly={flag}"),
        rule("Airplane Off + Emergency (partial)", {"airplane_mode": False, "emergency_only": G1}, regex=f"airplaneMode=false.*emergencyOnly={flag}"),
        rule("Airplane Mode On (simple)", {"airplane_mode": True}, text="airplaneMode=true"),
        rule("Airplane Mode Off (simple)", {"airplane_mode": False}, text="airplaneMode=false"),
    ]


def auto_blocker() -> list[Rule]:
    alias = "rampart_main_setting_alias"
    rules = [_rule(f"Auto Blocker {'On' if on else 'Off'}", {"enabled": on, "source": "logcat"}, tag="SecDynamicFragment",
                   regex=rf"{alias}.*isCheck\s*:\s*{str(on).lower()}") for on in (True, False)]
    for part in ("PLATFORM", "NON-PLATFORM"):
        rules += [_rule(f"Auto Blocker {'On' if on else 'Off'} (dumpstate, {part.lower()})", {"enabled": on, "source": "dumpstate"},
                        section=f"APP PROVIDERS {part}",
                        regex=rf"{alias}\s*\|\s*Auto Blocker\s*\|[^|]*\|\s*{int(on)}\s*\|") for on in (True, False)]
    return rules


def thermal_state() -> list[Rule]:
    """``PATHM`` is tried before ``PA``, whose name it starts with."""
    svc, eng = "thermalservice", "ThermalEngine"
    temp = lambda name, field, end="": _rule(f"{name} Temperature", {field: G1}, section=svc,
                                             regex=rf"Temperature\{{mValue=([0-9.]+).*mName={name}{end}")
    return [
        _rule("Thermal Status", {"thermal_status": G1}, section=svc, regex=r"Thermal Status:\s*(\d+)"),
        temp("AP", "temp_ap"), temp("SKIN", "temp_skin"), temp("BAT", "temp_bat"), temp("PATHM", "temp_pathm"),
        temp("PA", "temp_pa", r"[,\}]"), temp("USB", "temp_usb"),
        _rule("CPU Count", {"num_cpus": G1}, tag=eng, regex=r"Number of cpus\s*:(\d+)"),
        _rule("GPU Count", {"num_gpus": G1}, tag=eng, regex=r"Number of gpus\s*:(\d+)"),
    ]


def wifi_state() -> list[Rule]:
    sm, sam = "WifiStateMachine", "SemWifiApAdvancedAutohotspotService"
    link = ("ssid", "signal_dbm", "ip_address")
    ip = r"\d+\.\d+\.\d+\.\d+"
    return [
        _rule("WiFi Enabled", {"enabled": True}, tag=sm, text="CMD_ENABLE_NETWORK"),
        _rule("WiFi Associated", {"ssid": G1}, tag=sm, regex=r"ssid=([^\s,]+)"),
        _rule("WiFi Connected", {"ssid": G1, "signal_dbm": G2}, tag="WifiInfo", regex=r"SSID=([^\s,]+).*SignalLevel=(-?\d+)"),
        _rule("IP Assigned", {"ip_address": G1}, tag="DhcpClient", regex=f"Confirmed new address ({ip})"),
        _rule("WiFi Disabled", {"enabled": False}, link, tag=sm, text="CMD_DISABLE_NETWORK"),
        _rule("WiFi Disconnected", {"ssid": ""}, ("ip_address",), tag=sm, text="DISCONNECTING"),
        _rule("WiFi Disabled (Samsung)", {"enabled": False}, link, tag=sam, text="CMD_WIFI_OFF"),
        _rule("WiFi Enabled (Samsung)", {"enabled": True}, tag=sam, text="CMD_WIFI_ON"),
        _rule("WiFi Disconnected (Samsung)", {"ssid": ""}, ("signal_dbm", "ip_address"), tag=sam, text="CMD_WIFI_DISCONNECTED"),
        _rule("WiFi Connected (Samsung)", {"enabled": True}, tag=sam, text="CMD_WIFI_CONNECTED"),
        _rule("WiFi SSID (Samsung)", {"ssid": G1}, tag_re="SemRoamingAssistant", regex=r"wifiStateChangeEvent\[1\]\[\"([^\"]+)\""),
        _rule("IP + Signal Connected (Samsung)", {"ip_address": G1, "signal_dbm": G2}, tag="ConnectivityService",
              regex=rf"IP: /({ip}).*RSSI: (-?\d+)"),
        _rule("Signal Update (Samsung)", {"signal_dbm": G1}, tag_re="SemIWCMonitor", regex=r"RSSI:(-?\d+)"),
    ]


def wlan_disconnect() -> list[Rule]:
    st = lambda s, **more: {"connection_state": s, **more}
    fresh = {"last_reason": "", "locally_generated": ""}
    client = (("AOSP", "WifiClientModeImpl"), ("Samsung", "SemClientModeImpl"))
    sam = "SemWifiApAdvancedAutohotspotService"
    lost, named = f"CTRL-EVENT-DISCONNECTED bssid={MAC}", r"WLAN_REASON_(\w+)"
    event = rf"NETWORK_DISCONNECTION_EVENT.*bssid:\s*{MAC}.*reasonCode:\s*(\d+).*locallyGenerated:\s*"
    sides = (("local", "yes", 1, "true"), ("remote", "no", 0, "false"))
    rules = [_rule(f"Disconnected ({side}, wpa_supplicant)", st("disconnecting", bssid=G1, locally_generated=yn),
                   regex=f"{lost}.*locally_generated={n}") for side, yn, n, _ in sides]
    rules += [
        _rule("Disconnected (wpa_supplicant, no LG)", st("disconnecting", bssid=G1), regex=lost),
        _rule("Connected (wpa_supplicant)", st("connected", bssid=G1, **fresh), regex=f"CTRL-EVENT-CONNECTED.*{MAC}"),
    ]
    rules += [_rule(f"Deauth ({side}, named reason)", st("disconnecting", last_reason=G1, locally_generated=yn),
                    regex=f"{named}.*LG: {n}") for side, yn, n, _ in sides]
    rules += [
        _rule("Deauth (named reason, no LG)", st("disconnecting", last_reason=G1), regex=named),
        _rule("Deauth (numeric reason)", st("disconnecting", last_reason=G1), regex=r"[Dd]isconnect reason[=: ]+(\d+)"),
    ]
    rules += [_rule(f"Disconnected ({maker})", st("disconnected"), tag=tag, regex=r"(?i)disconnectedstate.enter") for maker, tag in client]
    rules += [_rule(f"Disconnected (network event, {side})", st("disconnected", bssid=G1, last_reason=G2, locally_generated=yn),
                    section="wifi", regex=event + flag) for side, yn, _, flag in sides]
    rules += [
        _rule("Disconnected (network event)", st("disconnected"), section="wifi", text="NETWORK_DISCONNECTION_EVENT"),
        _rule("Disconnected (Samsung high-level)", st("disconnected", **fresh), tag=sam, text="CMD_WIFI_DISCONNECTED"),
    ]
    rules += [_rule(f"Connecting ({maker})", st("connecting"), tag=tag, text="CMD_START_CONNECT") for maker, tag in client]
    rules += [_rule(f"L2 Connected ({maker})", st("connected", **fresh), tag=tag, regex=r"(?i)l2connectedstate.enter") for maker, tag in client]
    rules.append(_rule("Connected (Samsung high-level)", st("connected"), tag=sam, text="CMD_WIFI_CONNECTED"))
    return rules


def _none(*names: str) -> dict:
    return dict.fromkeys(names)


SYSTEM, NORMAL = "SYSTEM LOG", "DUMPSYS NORMAL"
TRACKERS = [
    Tracker("app-lifecycle", app_lifecycle, _none("foreground_app", "foreground_activity", "last_crash", "crashed")),
    Tracker("battery-health", battery_health, {"health": None, "swelling_mode": "NONE", "protect_mode": None, "charger_type": "NORMAL"}),
    Tracker("battery-state", battery_state, _none("level", "status", "charging", "plugged", "voltage", "temperature", "current_avg",
                                                  "charge_type", "charger_type", "hvc")),
    Tracker("cellular-registration-state", cellular_registration,
            {"voice_reg_state": "UNKNOWN", "data_reg_state": "UNKNOWN", "rat": "UNKNOWN", "operator": "", "slot": "0", "reject_code": "",
             "combined_reg_state": "", "nr_state": ""}, (SYSTEM, RADIO_LOG), needs_section=True),
    Tracker("memory-pressure", memory_pressure, {**_none("mem_available", "mem_free_target", "release_target", "protected_lru_count"),
                                                 "trigger_source": "UNKNOWN"}),
    Tracker("network-connectivity", network_connectivity, _none("connected", "network_type", "validated"), (SYSTEM,)),
    Tracker("p2p-group-formation-tracker", p2p_group_formation,
            {"formation_state": "idle", "role": "unknown", "peer_device": None, "peer_mac": None, "operating_freq": None,
             "go_neg_status": "none", "failure_reason": "none", "race_detected": False, "group_interface": None, "ssid": None}),
    Tracker("p2p-wps-provisioning-tracker", p2p_wps_provisioning,
            {"wps_state": "idle", "wps_method": "unknown", "peer_mac": None, "eap_state": None, "group_interface": None,
             "failure_reason": "none"}),
    Tracker("radio-airplane-mode-state", airplane_mode,
            {"airplane_mode": False, "data_connected": False, "emergency_only": False, "sim_card_state": "UNKNOWN"}, (SYSTEM,)),
    Tracker("samsung-auto-blocker", auto_blocker, _none("enabled", "source"), (SYSTEM,), needs_section=True),
    Tracker("thermal-state", thermal_state, {"thermal_status": None, **{f"temp_{k}": "unknown" for k in (
        "ap", "skin", "bat", "pa", "usb", "pathm")}, "num_cpus": None, "num_gpus": None}, (SYSTEM, NORMAL), needs_section=True,
            mode="snapshot"),
    Tracker("wifi-state", wifi_state, _none("enabled", "ssid", "signal_dbm", "ip_address")),
    Tracker("wlan-disconnect-tracker", wlan_disconnect,
            {"connection_state": "unknown", "last_reason": "", "locally_generated": "", "bssid": ""}, (SYSTEM, NORMAL), needs_section=True),
]
