"""Schemas of the frames that operators and sources exchange, as DDL."""



SITES = (
    "site_id bigint, chrom string, pos bigint, id string, ref string, alts array<string>, qual double, qual_str string, filters array<string>, info map<string,string>"
)
CALLS = (
    "site_id bigint, sample_idx int, sample string, gt array<int>, phased boolean, ad array<int>, dp int, gq int, min_dp int, pl array<int>, other map<string,string>"
)
GVCF = (
    "chrom string, pos bigint, id string, ref string, alts array<string>, qual double, filter string, end_pos bigint, gt array<int>, phased boolean, dp int, gq int, min_dp int, pl array<int>, ad array<int>"
)
BENCH = (
    "date string, git string, host string, cpu string, threads int, compressor string, dataset string, mode string, step string, "
    "variants bigint, elapsed_s double, rss_kb bigint, throughput_vps double, metric_a double, metric_b double, notes string"
)
